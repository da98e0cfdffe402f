"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import line_quality, mixing, near_dup
from .url_filter import RULES

_WORDS = r"len(regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+'))"


def words(column: str) -> str:
    return _WORDS.format(column)


def _seats(parties: str, group: str, name: str, votes: str, seats: str, out: str, prefix: str) -> str:
    """Seats by the highest quotients, as CTEs that end in ``{prefix}_done``."""
    return f"""
{prefix}_a AS (SELECT *, sum({votes}) OVER (PARTITION BY {group})::DOUBLE AS votes_, count(*) OVER (PARTITION BY {group}) AS m_ FROM {parties}),
{prefix}_b AS (SELECT *, CASE WHEN votes_ > 0 THEN {votes} / votes_ * {seats} ELSE 0.0 END AS fair_, ceil((m_ + 1) * CASE WHEN votes_ > 0 THEN {votes} / votes_ ELSE 0.0 END) + 2 AS half_ FROM {prefix}_a),
{prefix}_c AS (SELECT *, greatest(floor(fair_) - half_, 0)::BIGINT AS low_, (floor(fair_) + half_ + 1)::BIGINT AS high_ FROM {prefix}_b),
{prefix}_d AS (SELECT *, {seats} - sum(low_) OVER (PARTITION BY {group}) AS rest_ FROM {prefix}_c),
{prefix}_e AS (SELECT {group}, {name}, rest_, {votes}::DOUBLE / (2 * j + 1) AS quotient_, j FROM (SELECT *, unnest(range(low_, high_ + 1)) AS j FROM {prefix}_d WHERE {votes} > 0)),
{prefix}_f AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY quotient_ DESC, {name}, j) AS r_ FROM {prefix}_e),
{prefix}_g AS (SELECT {group}, {name}, count(*) AS won_ FROM {prefix}_f WHERE r_ <= rest_ GROUP BY ALL),
{prefix}_done AS (SELECT d.*, (low_ + coalesce(won_, 0))::BIGINT AS {out} FROM {prefix}_d d LEFT JOIN {prefix}_g g USING ({group}, {name}))"""


def mix_ctes(docs: str) -> str:
    """CTEs over ``docs`` (doc_id, text, source) that end in ``mixed`` (rid, doc_id, size, source_size, target, taken)."""
    weights = "[" + ", ".join(f"{w}.0" for w in mixing.WEIGHTS) + "]"
    return f"""
sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, {words('text')}::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS turn FROM {docs}),
src AS (SELECT skey, sum(size)::BIGINT AS size FROM sized GROUP BY skey),
src1 AS (SELECT *, ({weights}::DOUBLE[])[(row_number() OVER (ORDER BY skey) - 1) % {len(mixing.WEIGHTS)} + 1] AS w, size * {float(mixing.MOST)}::DOUBLE AS cap FROM src),
src2 AS (SELECT *, sum(size) OVER ()::DOUBLE AS total, coalesce(sum(cap) OVER u, 0.0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER u, 0.0) AS remaining, row_number() OVER (ORDER BY cap / w, skey) AS pos_
  FROM src1 WINDOW u AS (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src3 AS (SELECT *, (total - capped) / remaining AS level FROM src2),
src4 AS (SELECT *, min_by(level, pos_) FILTER (WHERE level * w <= cap) OVER () AS stands FROM src3),
src5 AS (SELECT skey, size AS source_size, CASE WHEN total > 0 THEN least(cap, coalesce(stands * w, cap)) ELSE 0.0 END AS target, greatest(least(ceil(size / {mixing.SHARD}), {mixing.SHARDS_MOST}), 1)::BIGINT AS shards, ceil(sum(size) OVER () / {mixing.BLOCK})::BIGINT AS blocks, 0 AS g FROM src4),
{_seats('src5', 'g', 'skey', 'target', 'blocks', 'quota', 's')},
placed AS (SELECT z.doc_id, z.size, z.turn, z.skey, s.source_size, s.target, s.quota, (('0x' || substr(z.turn, 1, 8))::BIGINT % s.shards) AS shard FROM sized z JOIN s_done s USING (skey)),
shard AS (SELECT skey, shard, quota, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL),
{_seats('shard', 'skey', 'shard', 'shard_size', 'quota', 'shard_quota', 'h')},
lined AS (SELECT p.*, h.shard_size, least(h.shard_quota * {mixing.BLOCK}, h.shard_size * {mixing.MOST}) AS due, sum(p.size) OVER (PARTITION BY p.skey, p.shard ORDER BY p.turn, p.doc_id NULLS FIRST, p.size ROWS UNBOUNDED PRECEDING) AS stop FROM placed p JOIN h_done h USING (skey, shard)),
rounds AS (SELECT *, CASE WHEN shard_size > 0 THEN due // shard_size ELSE 0 END AS rounds FROM lined),
mixed AS (SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(stop, due - rounds * shard_size) - (stop - size)))::BIGINT AS taken FROM rounds)"""


def near_dup_ctes(docs: str, percent: int) -> str:
    """CTEs over ``docs`` (rid, doc_id, text) that end in ``grouped`` (rid, doc_id, n_shingles, component_id)."""
    n = near_dup.WORDS
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
n1 AS (SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
n2 AS (SELECT DISTINCT rid, s FROM (
  SELECT rid, {shingle} AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {n - 2})) AS i FROM n1 WHERE len(w) >= {n})
  UNION ALL SELECT rid, array_to_string(w, ' ') FROM n1 WHERE len(w) BETWEEN 1 AND {n - 1})),
n3 AS (SELECT rid, count(*) AS n FROM n2 GROUP BY rid),
n4 AS (SELECT x.rid AS a, y.rid AS b, count(*) AS met FROM n2 x JOIN n2 y ON x.s = y.s AND x.rid <> y.rid GROUP BY ALL),
n5 AS MATERIALIZED (SELECT a, b FROM n4 JOIN n3 x ON x.rid = a JOIN n3 y ON y.rid = b WHERE 100 * met >= {percent} * (x.n + y.n - met)),
n6(rid, reached) AS (SELECT rid, rid FROM n1 UNION SELECT n6.rid, n5.b FROM n6 JOIN n5 ON n5.a = n6.reached),
n7 AS (SELECT n6.rid, min(n1.doc_id) AS component_id FROM n6 JOIN n1 ON n1.rid = n6.reached GROUP BY n6.rid),
grouped AS (SELECT n1.rid, n1.doc_id, coalesce(n3.n, 0)::BIGINT AS n_shingles, n7.component_id FROM n1 LEFT JOIN n3 USING (rid) JOIN n7 USING (rid))"""


OP2 = f"WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {near_dup_ctes('src', near_dup.PERCENT)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM grouped"


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def quality_ctes(docs: str) -> str:
    """CTEs over ``docs`` (rid, doc_id, text) that end in ``judged`` (rid, doc_id, the counts, base_failed, left_words, kept)."""
    q = line_quality
    word = r"'[^\x20\x09-\x0D]+'"
    symbols = f"length(l) - length(regexp_replace(l, '[{q.SYMBOLS}]', '', 'g'))"
    seps = " + ".join(f"len(list_filter(w, lambda x: x = '{s}'))" for s in q.SEPARATORS)
    low = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fails = f"""(NOT {_any('l', q.SENTENCE_MARKS)} OR (n >= 4 AND 2 * len(list_filter(w, lambda x: ends_with(x, '!'))) > n) OR 2 * ({symbols}) > n
      OR (({seps}) >= 2 AND 5 * ({seps}) >= n) OR (n >= {q.FILLER_WORDS} AND 4 * len(list_distinct(w)) <= n) OR {_any(low, q.BOILERPLATE)})"""
    return f"""
q1 AS (SELECT rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM {docs}),
qline AS (SELECT rid, l, regexp_extract_all(l, {word}) AS w FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM q1)),
qfail AS (SELECT rid, l, n, {fails} AS bad FROM (SELECT *, len(w) AS n FROM qline WHERE len(w) > 0)),
qlines AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines, sum(CASE WHEN bad THEN 0 ELSE n END) AS left_words FROM qfail GROUP BY rid),
qwin AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM q1 WHERE len(w) >= 3)),
qrep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM qwin) WHERE c > 1) GROUP BY rid),
qbase AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[{q.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(left_words, 0)::BIGINT AS left_words FROM q1 LEFT JOIN qlines USING (rid) LEFT JOIN qrep USING (rid)),
qfailed AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM qbase),
judged AS (SELECT *, NOT base_failed AND 100 * left_words >= {q.LEAST_LEFT} * n_words AS kept FROM qfailed)"""


OP3 = f"WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {quality_ctes('src')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, kept FROM judged"

OP5 = f"WITH {mix_ctes('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"

_ESCAPED = "(length({0}) + length({0}) - length(replace({0}, '\\', '')) + length({0}) - length(replace({0}, '<', '')) + length({0}) - length(replace({0}, '[', '')) + length({0}) - length(replace({0}, '|', '')))"

OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_ESCAPED.format('role')} + {_ESCAPED.format('text')} + length('<||><|end|>'))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

_RULES = ", ".join(f"('{v}', '{k}', '{k.partition('/')[0]}', '/{k.partition('/')[2]}')" for v, k in RULES)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

OP10 = f"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {_RULES}),
p AS (SELECT row_number() OVER () AS rid, page_id,
  translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
hit AS (SELECT p.rid, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY p.rid)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (rid)"""
