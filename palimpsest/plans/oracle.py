"""DuckDB SQL of the queries in ``queries.py``."""

from __future__ import annotations

from .queries import PAGE, RESERVED, SINCE

REVS = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e2 AS (SELECT *, rn - rn // 4 AS gen, (rn - rn // 4) || '-' || lpad(event_id::VARCHAR, 8, '0') AS rev FROM e),
revs AS (SELECT user_id::VARCHAR AS id, rev, gen::BIGINT AS gen,
  CASE WHEN rn = 1 THEN NULL WHEN rn % 4 IN (0, 1) THEN lag(rev, 2) OVER w ELSE lag(rev, 1) OVER w END AS parent_rev,
  event_id + 1 AS seq, (event_type = 'error' OR user_id % 10 = 0) AS deleted, props AS body, event_type AS type, value AS size, rn
  FROM e2 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
leaves AS (SELECT * FROM revs r WHERE NOT EXISTS (SELECT 1 FROM revs c WHERE c.id = r.id AND c.parent_rev = r.rev)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY deleted, gen DESC, rev DESC) AS place FROM leaves),
won AS (SELECT * FROM ranked WHERE place = 1),
docs AS (SELECT w.id, w.rev AS winning_rev, w.deleted, m.updated_seq FROM won w JOIN (SELECT id, max(seq) AS updated_seq FROM revs GROUP BY id) m USING (id))"""

FILES = """
files AS (SELECT d.doc_id, d.lang || '/' || d.source || '/' || d.doc_id || '.md' AS path, d.n_chars::DOUBLE AS size, (d.doc_id * 1000)::DOUBLE AS mtime,
  coalesce(l.toxic, 0) = 1 AS gone FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
live AS (SELECT * FROM files WHERE NOT gone)"""

TOKENS = "tok AS (SELECT doc_id, t.term, t.position FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x, i: {'term': x, 'position': i - 1})) AS t FROM documents))"
LENGTHS = "len_ AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS length FROM documents)"


def _revs(sql: str) -> str:
    """A query over the forest; one that begins with a comma goes on with CTEs of its own."""
    return f"WITH {REVS} {sql}"


def _files(sql: str) -> str:
    return f"WITH {FILES} {sql}"


def _number(path: str) -> str:
    """The text that a JSON number or string field reads as."""
    return f"(body ->> '{path}')"


def _bm25(tf: str, df: str, length: str, n: str, average: str) -> str:
    return f"(ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / {average})))"


def _search(matches: str, phrases: int) -> str:
    return f"""WITH {TOKENS}, {LENGTHS}, m AS ({matches}),
df AS (SELECT phrase, count(*) AS df FROM m GROUP BY phrase), st AS (SELECT greatest(count(*), 1) AS n, greatest(avg(length), 1.0) AS average FROM len_),
s AS (SELECT m.doc_id, {_bm25('m.tf', 'df.df', 'len_.length', 'st.n', 'st.average')} AS s, m.tf FROM m JOIN df USING (phrase) JOIN len_ USING (doc_id) CROSS JOIN st)
SELECT doc_id, round(sum(s), 6) AS score, sum(tf)::BIGINT AS match_count FROM s GROUP BY doc_id HAVING count(*) = {phrases} ORDER BY sum(s) DESC, doc_id LIMIT 50"""


_SEG = """docs AS (SELECT doc_id::VARCHAR AS path, doc_id, text FROM documents),
segs AS (SELECT 'a' AS segment, doc_id AS doc, path, CASE WHEN doc_id % 4 = 0 THEN text || '~' ELSE text END AS body FROM docs UNION ALL SELECT 'b', doc_id, path, text FROM docs WHERE doc_id % 2 = 0),
named AS (SELECT *, md5(body) AS hash, length(body)::BIGINT AS chars FROM segs),
cur AS (SELECT path, md5(text) AS hash FROM docs)"""

_VECTOR = "[" + ", ".join(str(round(((i * 37) % 64 - 31.5) / 100, 4)) for i in range(64)) + "]::DOUBLE[]"

SQL: dict[str, str] = {
    "rev_leaves": _revs("SELECT id, rev, gen, deleted FROM leaves"),
    "rev_winners": _revs("SELECT * FROM docs"),
    "rev_conflicts": _revs("SELECT id, count(*) AS n, string_agg(rev, ',' ORDER BY rev) AS conflicts FROM ranked WHERE place > 1 AND NOT deleted GROUP BY id"),
    "changes_main": _revs(f"SELECT updated_seq AS seq, id, winning_rev AS revs, deleted FROM docs WHERE updated_seq > 0 ORDER BY updated_seq LIMIT {PAGE}"),
    "changes_all_docs": _revs(f"SELECT d.updated_seq AS seq, d.id, string_agg(l.rev, ',' ORDER BY l.rev) AS revs, d.deleted FROM docs d JOIN leaves l USING (id) GROUP BY ALL ORDER BY seq LIMIT {PAGE}"),
    "changes_selector": _revs(
        f"SELECT d.updated_seq AS seq, d.id, string_agg(l.rev, ',' ORDER BY l.rev) AS revs, d.deleted FROM docs d JOIN leaves l USING (id) WHERE l.type <> 'view' AND l.size >= 20 GROUP BY d.updated_seq, d.id, d.deleted ORDER BY seq LIMIT {PAGE}"
    ),
    "changes_pending": _revs(
        f", page AS (SELECT updated_seq FROM docs WHERE updated_seq > {SINCE} ORDER BY updated_seq LIMIT 10), at_ AS (SELECT CASE WHEN count(*) >= 10 THEN max(updated_seq) ELSE (SELECT max(updated_seq) FROM docs) END AS last_seq FROM page) SELECT last_seq, (SELECT count(*) FROM docs WHERE updated_seq > last_seq) AS pending FROM at_"
    ),
    "find_range": _revs("SELECT id, rev, body FROM won WHERE NOT deleted AND (body ->> 'k')::DOUBLE >= 10 AND (body ->> 'k')::DOUBLE < 60 "),
    "find_in_nin": _revs("SELECT id, rev, body FROM won WHERE NOT deleted AND type IN ('click', 'view') AND (body ->> 'k')::DOUBLE NOT IN (1, 2, 3) "),
    "find_exists": _revs("SELECT id, rev, body FROM won WHERE NOT deleted AND json_exists(body, '$.k') AND NOT json_exists(body, '$.none') "),
    "find_regex": _revs("SELECT id, rev, body FROM won WHERE NOT deleted AND regexp_matches(type, '^(click|p.*e)$') "),
    "find_or_and": _revs("SELECT id, rev, body FROM won WHERE NOT deleted AND (type = 'purchase' OR ((body ->> 'k')::DOUBLE > 50 AND size < 40)) "),
    "find_mixed_type_compare": _revs(f"SELECT id, rev, body FROM won WHERE NOT deleted AND {_number('k')} < '5' "),
    "find_page": _revs("SELECT id, rev FROM won WHERE NOT deleted AND (body ->> 'k')::DOUBLE >= 1 ORDER BY id LIMIT 25"),
    "numbers_as_text": "WITH p AS (SELECT o_orderkey, regexp_replace((o_totalprice * 1000)::VARCHAR, '\\.0$', '') AS shown FROM orders) SELECT o_orderkey, shown, shown < '5' AS below FROM p",
    "all_docs_range": _revs("SELECT id, winning_rev AS rev FROM docs WHERE NOT deleted AND id >= '1' AND id < '5' ORDER BY id LIMIT 50 OFFSET 3"),
    "all_docs_desc": _revs("SELECT id, winning_rev AS rev FROM docs WHERE NOT deleted AND id <= '7' AND id >= '3' ORDER BY id DESC LIMIT 40"),
    "all_docs_keys": _revs(
        "SELECT k.pos, k.key, d.winning_rev AS rev, coalesce(d.deleted, false) AS deleted, CASE WHEN d.winning_rev IS NULL THEN 'not_found' END AS error FROM (VALUES (0, '3'), (1, 'none'), (2, '10'), (3, '3')) k(pos, key) LEFT JOIN docs d ON d.id = k.key"
    ),
    "revs_diff": _revs("SELECT id, count(*) AS n, string_agg(rev || 'x', ',' ORDER BY rev || 'x') AS missing FROM revs GROUP BY id"),
    "bulk_get": _revs(
        ", a AS (SELECT r.seq AS pos, r.id, CASE WHEN r.seq % 2 = 0 THEN r.rev ELSE d.winning_rev END AS rev FROM revs r LEFT JOIN (SELECT * FROM docs WHERE NOT deleted) d USING (id)) SELECT a.pos, a.id, a.rev, coalesce(r.deleted, false) AS deleted, r.body AS doc, CASE WHEN r.body IS NULL THEN 'not_found' END AS error FROM a LEFT JOIN revs r ON r.id = a.id AND r.rev = a.rev"
    ),
    "open_revs_latest": "WITH RECURSIVE "
    + REVS.strip()
    + """, reach(id, leaf, at_) AS (SELECT id, rev, rev FROM leaves UNION ALL SELECT reach.id, reach.leaf, r.parent_rev FROM reach JOIN revs r ON r.id = reach.id AND r.rev = reach.at_ WHERE r.parent_rev IS NOT NULL)
SELECT id, at_ AS rev, count(*) AS n, min(leaf) AS first, max(leaf) AS last FROM reach GROUP BY id, at_""",
    "public_docs": _revs(
        """, c AS (SELECT id, list(rev ORDER BY rev) AS conflicts FROM ranked WHERE place > 1 AND NOT deleted GROUP BY id)
SELECT won.id, '{"_id":"' || won.id || '","_rev":"' || won.rev || '"' || CASE WHEN won.deleted THEN ',"_deleted":true' ELSE '' END
  || coalesce(',"_conflicts":["' || array_to_string(c.conflicts, '","') || '"]', '') || ',"k":' || (won.body ->> 'k') || '}' AS doc FROM won LEFT JOIN c USING (id)"""
    ),
    "replicate_batch": _revs(
        f"SELECT id, rev, gen, parent_rev, CASE WHEN seq <= {SINCE} THEN seq ELSE {SINCE} + row_number() OVER (PARTITION BY seq > {SINCE} ORDER BY seq) END AS seq, deleted, true AS body_available FROM revs"
    ),
    "local_edits": _revs(
        """, live AS (SELECT *, split_part(winning_rev, '-', 1)::BIGINT + 1 AS g FROM docs WHERE NOT deleted)
SELECT updated_seq * 2 AS pos, id, g || '-' || substr(sha1('{"a":"' || id || '","b":1}' || chr(10) || winning_rev), 1, 32) AS rev, 'ok' AS status FROM live
UNION ALL SELECT updated_seq * 2 + 1, id, NULL, 'conflict' FROM live"""
    ),
    "local_checkpoints": """WITH u AS (SELECT user_id, max(event_id) AS at_ FROM events GROUP BY user_id), w AS (SELECT *, '{"last_seq":' || at_ || '}' AS body, user_id % 2 = 1 OR user_id % 4 = 0 AS fits FROM u)
SELECT user_id * 2 + n AS pos, user_id::VARCHAR AS id, CASE WHEN fits AND n = 0 THEN '0-' || substr(sha1(body), 1, 16) END AS rev, CASE WHEN fits AND n = 0 THEN 'ok' ELSE 'conflict' END AS status,
  CASE WHEN fits THEN body ELSE '{}' END AS now FROM w CROSS JOIN (VALUES (0), (1)) t(n)""",
    "link_ancestors": _revs(
        ", steps AS (SELECT id, rev, parent_rev AS parent, 1 AS own FROM leaves UNION ALL SELECT id, parent_rev, NULL, 0 FROM leaves WHERE parent_rev IS NOT NULL) SELECT id, rev, max(parent) AS parent_rev, max(own) = 0 AS stub FROM steps GROUP BY id, rev"
    ),
    "compact_changes": _revs("SELECT updated_seq AS seq, id, winning_rev AS rev, deleted FROM docs"),
    "compact_revs": _revs(
        "SELECT r.id, count(*) AS revs, count(l.rev) AS bodies, sum(CASE WHEN l.rev IS NULL THEN 2 ELSE length(r.body) END)::BIGINT AS chars FROM revs r LEFT JOIN leaves l ON l.id = r.id AND l.rev = r.rev GROUP BY r.id"
    ),
    "db_info": _revs("SELECT count(*) FILTER (NOT deleted) AS doc_count, count(*) FILTER (deleted) AS doc_del_count, coalesce(max(updated_seq), 0) AS update_seq FROM docs"),
    "index_status": "SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS pending, count(*) FILTER (toxic <> 1 OR toxic IS NULL) AS indexed, count(*) FILTER (toxic = 0 AND quality <> 1) AS fts_pending FROM labels",
    "reassemble": """WITH t AS (SELECT * FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 0)),
g AS (SELECT conv_id, count(*) AS pieces, CASE WHEN count(*) = max(turn) + 1 AND count(text) = count(*) THEN string_agg(text, '' ORDER BY turn) END AS content FROM t GROUP BY conv_id)
SELECT conv_id, pieces, length(content)::BIGINT AS chars, md5(content) AS digest FROM g""",
    "list_files": _files("SELECT path, size FROM live"),
    "list_directory": _files(
        ", r AS (SELECT substr(path, 4) AS rest FROM files WHERE starts_with(path, 'en/')) SELECT DISTINCT CASE WHEN contains(rest, '/') THEN 'directory' ELSE 'file' END AS type, split_part(rest, '/', 1) AS name, 'en/' || split_part(rest, '/', 1) AS path FROM r"
    ),
    "recent_notes": _files("SELECT path, strftime(make_timestamp((mtime * 1000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%gZ') AS modified_at FROM live ORDER BY mtime DESC, path LIMIT 20"),
    "prefix_list": _files("SELECT path, (SELECT count(*) FROM live WHERE starts_with(path, 'de/src1')) AS total FROM live WHERE starts_with(path, 'de/src1') ORDER BY path LIMIT 100"),
    "reserved_filter": _files(f"SELECT path FROM files WHERE ends_with(path, '.md') AND path <> '{RESERVED}' AND NOT starts_with(path, '{RESERVED}/') AND NOT starts_with(path, 'fr/') AND NOT regexp_matches(path, '(^|/)\\.') AND NOT starts_with(path, 'i:')"),
    "similar_paths": _files("SELECT path FROM files WHERE contains(lower(path), 'src12') ORDER BY path LIMIT 5"),
    "daily_notes": """WITH n AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date, 'daily/' || user_id || '/' || CASE WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y%m%d') END || '.md' AS path FROM events)
SELECT date, path FROM n ORDER BY date DESC, path LIMIT 20""",
    "hash_content": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "dedupe_content": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "hash_skip": "SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents WHERE doc_id % 3 = 0",
    "chunk_content": """WITH c AS (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000)::BIGINT)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, i::INTEGER AS chunk_index, length(substring(text, i * 1000 + 1, 1000))::INTEGER AS chars, md5(substring(text, i * 1000 + 1, 1000)) AS digest FROM c""",
    "tokenize_words": "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) AS digest FROM documents",
    "postings": f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM tok GROUP BY ALL",
    "term_df": f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term",
    "corpus_stats": f"WITH {TOKENS} SELECT (SELECT count(*) FROM documents) AS doc_count, count(*) AS token_count, round(count(*) / (SELECT count(*) FROM documents), 6) AS avg_length FROM tok",
    "search_bm25": _search("SELECT term AS phrase, doc_id, count(*) AS tf FROM tok WHERE term IN ('the', 'of', 'thing') GROUP BY ALL", 3),
    "search_phrase": _search("SELECT 1 AS phrase, a.doc_id, count(*) AS tf FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id", 1),
    "search_fields": f"""WITH f AS (SELECT doc_id, 'body' AS field, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents UNION ALL SELECT doc_id, 'title', regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9_]+') FROM documents),
l AS (SELECT doc_id, field, len(w) AS length FROM f WHERE len(w) > 0), n AS (SELECT count(DISTINCT doc_id) AS n FROM l), av AS (SELECT field, n, greatest(sum(length) / n, 1.0) AS average FROM l CROSS JOIN n GROUP BY field, n),
m AS (SELECT term AS phrase, doc_id, field, count(*) AS tf FROM (SELECT doc_id, field, unnest(w) AS term FROM f) WHERE term IN ('and', 'is') GROUP BY ALL),
df AS (SELECT phrase, count(DISTINCT doc_id) AS df FROM m GROUP BY phrase),
s AS (SELECT m.doc_id, m.phrase, m.tf, CASE m.field WHEN 'body' THEN 1.0 ELSE 3.0 END * {_bm25('m.tf', 'df.df', 'l.length', 'av.n', 'av.average')} AS s FROM m JOIN df USING (phrase) JOIN av USING (field) JOIN l ON l.doc_id = m.doc_id AND l.field = m.field)
SELECT doc_id, round(sum(s), 6) AS score, sum(tf)::BIGINT AS match_count FROM s GROUP BY doc_id HAVING count(DISTINCT phrase) = 2 ORDER BY sum(s) DESC, doc_id LIMIT 50""",
    "index_append": f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok WHERE doc_id % 10 <> 0 GROUP BY term",
    "index_merge": f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok WHERE doc_id % 10 <> 0 GROUP BY term",
    "index_search": f"""WITH {TOKENS}, {LENGTHS}, t AS (SELECT * FROM tok WHERE doc_id % 10 <> 0), l AS (SELECT * FROM len_ WHERE doc_id % 10 <> 0),
m AS (SELECT 0 AS phrase, doc_id, count(*) AS tf FROM t WHERE term = 'the' GROUP BY doc_id UNION ALL SELECT 1, a.doc_id, count(*) FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id),
df AS (SELECT phrase, count(*) AS df FROM m GROUP BY phrase), st AS (SELECT greatest(count(*), 1) AS n, greatest(avg(length), 1.0) AS average FROM l),
s AS (SELECT m.doc_id, {_bm25('m.tf', 'df.df', 'l.length', 'st.n', 'st.average')} AS s, m.tf FROM m JOIN df USING (phrase) JOIN l USING (doc_id) CROSS JOIN st)
SELECT doc_id, round(sum(s), 6) AS score, sum(tf)::BIGINT AS match_count FROM s GROUP BY doc_id HAVING count(*) = 2""",
    "index_totals": f"WITH {LENGTHS} SELECT count(*) AS docs, sum(length)::BIGINT AS words FROM len_ WHERE doc_id % 10 <> 0",
    "segment_compact": f"""WITH {_SEG}, k AS (SELECT n.*, row_number() OVER (PARTITION BY path, hash ORDER BY segment, doc) AS nth FROM named n SEMI JOIN cur USING (path, hash)),
kept AS (SELECT *, (row_number() OVER (ORDER BY segment, doc) - 1)::INTEGER AS new_doc FROM k WHERE nth = 1),
t AS (SELECT new_doc, unnest(list_transform(regexp_extract_all(lower(body), '[a-z0-9_]+'), lambda x, i: {{'term': x, 'position': i - 1}})) AS t FROM kept),
p AS (SELECT new_doc, t.term AS term, string_agg(t.position::VARCHAR, ',' ORDER BY t.position) AS positions FROM t GROUP BY ALL),
w AS (SELECT new_doc, count(*) AS terms, sum(('0x' || substr(md5(term || ':' || positions), 1, 15))::BIGINT)::VARCHAR AS postings FROM p GROUP BY new_doc)
SELECT new_doc AS doc, path, hash, chars, coalesce(terms, 0) AS terms, coalesce(postings, '0') AS postings FROM kept LEFT JOIN w USING (new_doc)""",
    "fresh_hits": f"WITH {_SEG} SELECT n.path, n.hash FROM named n JOIN cur USING (path, hash) WHERE segment = 'a'",
    "vector_topk": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}) DESC, vec_id LIMIT 20",
    "gc_unreachable": "WITH RECURSIVE "
    + REVS.strip()
    + """, top AS (SELECT id, rev FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gen DESC, rev DESC) AS n FROM revs) WHERE n = 1),
reach(id, rev) AS (SELECT id, rev FROM top UNION SELECT reach.id, x.parent_rev FROM reach JOIN revs x ON x.id = reach.id AND x.rev = reach.rev WHERE x.parent_rev IS NOT NULL)
SELECT id, rev FROM revs ANTI JOIN reach USING (id, rev)""",
    "snapshot_replay": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, value FROM k WHERE n = 1 AND event_type <> 'error'",
    "mirror_delta": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'remove' WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 'put' ELSE 'keep' END AS action FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0",
    "mirror_status": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'remove' WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 'put' ELSE 'keep' END AS status, count(*) AS files FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0 GROUP BY 1",
    "debounce_sessions": """WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS fires, count(*) AS events FROM r GROUP BY user_id, run""",
    "coalesce_fixed": """WITH RECURSIVE s(user_id, started) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id
  UNION ALL SELECT s.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.started + INTERVAL 24 HOUR) FROM s
  WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.started + INTERVAL 24 HOUR))
SELECT s.user_id, s.started, count(*) AS events FROM s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.started AND e.ts < s.started + INTERVAL 24 HOUR GROUP BY ALL""",
    "lockout": """WITH b AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS bad FROM events),
t AS (SELECT user_id, ts FROM b WHERE event_type = 'error' AND bad > 2)
SELECT event_id, EXISTS (SELECT 1 FROM t WHERE t.user_id = b.user_id AND t.ts < b.ts AND t.ts >= b.ts - INTERVAL 24 HOUR) AS locked FROM b""",
    "registry_authorized": "SELECT n_name AS vault, n_regionkey::VARCHAR AS owner FROM nation WHERE n_regionkey = 2 OR n_nationkey % 4 = 2",
    "missing_chunks": "SELECT conv_id AS id, count(*) AS n, string_agg(conv_id || '-' || turn, ',' ORDER BY conv_id || '-' || turn) AS missing FROM conversations WHERE turn % 3 = 0 GROUP BY conv_id",
    "media_types": """SELECT 'a.b/' || page_id || '.' || ['png', 'md', 'bin', 'PDF', 'txt', 'html', 'css', 'mp3', 'wav', 'mp4', 'jpeg', 'svg', 'json', 'md/x'][page_id % 14 + 1] AS path,
  CASE WHEN page_id % 5 = 0 THEN 'text/x-own' ELSE ['image/png', 'text/markdown; charset=utf-8', 'application/octet-stream', 'application/pdf', 'text/plain; charset=utf-8', 'application/octet-stream', 'application/octet-stream',
    'audio/mpeg', 'audio/wav', 'video/mp4', 'image/jpeg', 'image/svg+xml', 'application/json', 'application/octet-stream'][page_id % 14 + 1] END AS media_type, true AS safe FROM pages""",
    "safe_paths": "SELECT page_id, page_id % 9 IN (0, 8) AS safe, page_id % 9 IN (2, 3, 5) AS hidden FROM pages",
    "base64_strict": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(substr(text, 1, 40)) END AS digest FROM documents WHERE length(text) > 0",
    "chunk_ids": """WITH c AS (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 100000)::BIGINT)) AS i FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, i, substring(text, i * 100000 + 1, 100000) AS piece FROM c)
SELECT doc_id, i::INTEGER AS pos, 'h:k' || substr(sha256('kuro-chunk' || chr(10) || length(piece) || chr(10) || piece), 1, 40) AS chunk, length(piece)::INTEGER AS chars FROM p""",
    "stored_chunks": """WITH c AS (SELECT text, unnest(range(0, ceil(length(text) / 100000)::BIGINT)) AS i FROM documents WHERE length(text) > 0), p AS (SELECT substring(text, i * 100000 + 1, 100000) AS piece FROM c)
SELECT DISTINCT 'h:k' || substr(sha256('kuro-chunk' || chr(10) || length(piece) || chr(10) || piece), 1, 40) AS id, md5(piece) AS digest FROM p""",
    "dependent_notes": "SELECT DISTINCT conv_id AS id FROM conversations WHERE md5(text) IN (SELECT md5(text) FROM conversations WHERE turn = 1)",
    "term_shards": f"""WITH {TOKENS}, t AS (SELECT DISTINCT term FROM tok),
h AS (SELECT term, list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split(term, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM t)
SELECT (h % 16)::INTEGER AS shard, (h // 16 % 64)::INTEGER AS bucket, count(*) AS terms FROM h GROUP BY ALL""",
    "revision_parts": _revs("SELECT id, rev, gen, split_part(rev, '-', 2) AS digest, NULL::BIGINT AS none FROM revs"),
    "vector_ids": "SELECT page_id, 'v1:' || substr(sha256(url || chr(0) || page_id), 1, 60) AS id FROM pages",
    "natural_order": _files(
        "SELECT path, row_number() OVER (ORDER BY split_part(path, '/', 1), regexp_replace(split_part(path, '/', 2), '[0-9]+$', ''), coalesce(try_cast(regexp_extract(split_part(path, '/', 2), '[0-9]+$') AS BIGINT), -1), regexp_extract(path, '([0-9]+)[.]md$', 1)::BIGINT) - 1 AS place FROM files"
    ),
    "mirror_sources": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'encrypted' WHEN doc_id % 7 = 0 THEN 'kind' WHEN n_chars > 5000 THEN 'size' END AS reason, md5(text) AS digest FROM documents""",
    "retry_delays": "SELECT event_id, least(900.0::DOUBLE, 5.0 * pow(2.0, least(event_id % 12, 8))) * 0.5 AS seconds FROM events",
    "stale_rewrite": f"WITH {_SEG}, f AS (SELECT segment, sum(CASE WHEN c.hash IS NULL THEN chars ELSE 0 END)::BIGINT AS freed, sum(chars)::BIGINT AS chars FROM named n LEFT JOIN cur c USING (path, hash) GROUP BY segment) SELECT segment, freed FROM f WHERE freed >= 1 AND freed >= chars * 0.1 ORDER BY freed DESC, segment LIMIT 1",
    "overlay_rows": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(md5(text)) ELSE md5(text) END AS digest FROM documents WHERE doc_id % 8 <> 0",
    "appended_blocks": """WITH b AS (SELECT doc_id, regexp_replace(substr(text, 1, 200), '\\s+$', '') AS base FROM documents)
SELECT doc_id, md5(CASE WHEN base = '' THEN '' ELSE base || chr(10) || chr(10) END || '- [ ] task' || chr(10)) AS digest FROM b""",
}
