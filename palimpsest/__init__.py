"""palimpsest: analytics over revisioned document collections, written for Spark.

Nothing here runs on import; every operator takes DataFrames and returns DataFrames.
"""
