"""DuckDB SQL of the training-data queries that SQL expresses, written without their operators' hashes."""

from __future__ import annotations

from lodestone.llm import line_dedup, mixing

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (coalesce(l.n, 0) - coalesce(l.u, 0))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_capitals
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_exclaims > n_words)::INT
  + 16 * (10 * n_capitals > 4 * word_chars)::INT + 32 * (2 * n_dup_lines > n_lines)::INT + 64 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, n_lines, n_exclaims, n_capitals FROM f"""


def _apportion(parties: str, group: str, tie: str, weight: str, seats: str) -> str:
    """SELECT of parties with got: highest quotients, of which all but the last few are settled at once."""
    return f"""
SELECT p.*, lo + coalesce(won, 0) AS got FROM (
  SELECT *, sum(lo) OVER (PARTITION BY {group}) AS los FROM (
    SELECT *, CASE WHEN {weight} > 0 AND {seats} > 0 THEN greatest(0, ceil({weight} * ({seats} - np / 2 - 1) / w - 0.5)) ELSE 0 END::BIGINT AS lo,
      CASE WHEN {weight} > 0 AND {seats} > 0 THEN floor({weight} * ({seats} + np / 2 + 1) / w + 0.5) + 1 ELSE 0 END::BIGINT AS hi
    FROM (SELECT *, (sum({weight}) OVER (PARTITION BY {group}))::DOUBLE AS w, (count_if({weight} > 0) OVER (PARTITION BY {group}))::DOUBLE AS np FROM {parties}))) p
LEFT JOIN (SELECT {group}, {tie}, count(*) AS won FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {weight} / (2 * a + 1)::DOUBLE DESC, {tie}) AS r FROM (
    SELECT *, unnest(range(lo, hi)) AS a FROM (SELECT *, sum(lo) OVER (PARTITION BY {group}) AS los FROM (
      SELECT *, CASE WHEN {weight} > 0 AND {seats} > 0 THEN greatest(0, ceil({weight} * ({seats} - np / 2 - 1) / w - 0.5)) ELSE 0 END::BIGINT AS lo,
        CASE WHEN {weight} > 0 AND {seats} > 0 THEN floor({weight} * ({seats} + np / 2 + 1) / w + 0.5) + 1 ELSE 0 END::BIGINT AS hi
      FROM (SELECT *, (sum({weight}) OVER (PARTITION BY {group}))::DOUBLE AS w, (count_if({weight} > 0) OVER (PARTITION BY {group}))::DOUBLE AS np FROM {parties})))))
  WHERE r <= {seats} - los GROUP BY ALL) q USING ({group}, {tie})"""


MIXING = f"""
WITH r AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE '=' || source END AS skey, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
rs AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (SELECT least({mixing.MAX_SHARDS}, greatest(1, (count(*) + {mixing.SHARD_DOCS - 1}) // {mixing.SHARD_DOCS})) FROM r) AS shard FROM r),
sz AS (SELECT skey, shard, sum(size)::BIGINT AS shard_size FROM rs GROUP BY ALL),
s AS (SELECT skey, sum(shard_size)::BIGINT AS source_size FROM sz GROUP BY skey),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS weight, {mixing.MAX_PASSES}.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
v AS (SELECT *, row_number() OVER o AS ord, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, skey)),
t AS (SELECT skey, source_size, least(cap, coalesce((SELECT arg_min(level, ord) FROM v WHERE level <= cap / weight), 0) * weight) AS target FROM v),
q AS (SELECT *, 0 AS g, (SELECT round(sum(target) / {mixing.BLOCK_WORDS})::BIGINT FROM t) AS seats FROM t),
b AS ({_apportion("q", "g", "skey", "target", "seats")}),
z AS (SELECT sz.*, b.source_size, b.target, least(b.got * {mixing.BLOCK_WORDS}, b.source_size * {mixing.MAX_PASSES}) AS dealt FROM sz JOIN b USING (skey)),
k AS (SELECT skey, shard, shard_size, source_size, target, got AS words FROM ({_apportion("z", "skey", "shard", "shard_size", "dealt")})),
p AS (SELECT rs.*, k.* EXCLUDE (skey, shard), coalesce(sum(size) OVER (PARTITION BY skey, shard ORDER BY substr(h, 9, 24), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes FROM rs JOIN k USING (skey, shard))
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, words - passes * shard_size - before)))::BIGINT AS taken FROM p"""

LINES = rf"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, text, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
n AS (SELECT *, lag(line) OVER o AS before, lead(line) OVER o AS after FROM a WHERE regexp_matches(line, '{WORD}') WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT doc_id, text, pos, before, after, list_transform(regexp_extract_all(line, '{WORD}'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{line_dedup.VARIABLE}' ELSE x END) AS w FROM n),
l AS (SELECT DISTINCT w, [len(w)::VARCHAR] || w[:{line_dedup.DEPTH}] AS leaf FROM w WHERE len(w) >= {line_dedup.DEPTH + line_dedup.LEAST_REST}),
c AS (SELECT leaf, w, m FROM (SELECT *, count(*) OVER (PARTITION BY leaf) AS m FROM l) WHERE m >= {line_dedup.MIN_DOCUMENTS}),
p AS (SELECT leaf, w, m, unnest(range({line_dedup.DEPTH + 1}, len(w) + 1)) AS place FROM c),
f AS (SELECT leaf, place, w[place] AS token FROM p GROUP BY ALL HAVING count(*) >= {line_dedup.MIN_DOCUMENTS} AND count(*) * {line_dedup.SHARE} >= any_value(m)),
k AS (SELECT p.leaf, p.w, list(f.token ORDER BY p.place) AS kept, count(*) - count(f.token) AS masked FROM p LEFT JOIN f ON f.leaf = p.leaf AND f.place = p.place AND f.token = p.w[p.place] GROUP BY ALL),
g AS (SELECT w, ['fields'] || leaf || list_transform(kept, lambda x: coalesce(x, '')) AS template FROM k WHERE masked > 0 AND masked * {line_dedup.MOST_VARIABLE} <= len(w)),
m AS (SELECT doc_id, text, pos, before, after, len(w) AS size, ['line'] || w AS template FROM w UNION ALL SELECT doc_id, text, pos, before, after, len(w), template FROM w JOIN g USING (w)),
s AS (SELECT * FROM m WHERE template IN (SELECT template FROM m GROUP BY template HAVING count(DISTINCT text) >= {line_dedup.MIN_DOCUMENTS})),
o AS (SELECT text FROM (SELECT DISTINCT text, pos, size FROM s) JOIN (SELECT text, sum(len(w)) / count(DISTINCT doc_id) AS total FROM w GROUP BY text) USING (text) GROUP BY text HAVING 2 * sum(size) <= any_value(total)),
e AS (SELECT template, text, min(doc_id) AS doc_id, min([before, after]) AS context FROM s GROUP BY ALL),
r AS (SELECT template, min(doc_id) AS first FROM e GROUP BY template HAVING count(DISTINCT context) >= {line_dedup.MIN_DOCUMENTS} OR count(*) FILTER (text IN (SELECT text FROM o)) >= {line_dedup.MIN_DOCUMENTS}),
z AS (SELECT DISTINCT doc_id, pos FROM s JOIN r USING (template) WHERE doc_id <> first)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (z.pos IS NULL), '') AS text, count(z.pos) AS n_dropped FROM a LEFT JOIN z USING (doc_id, pos) GROUP BY doc_id"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT doc_id, part, ((len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM p)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, mask = own AS alone, mask & own <> 0 AS fails, mask & before <> 0 AS gone FROM s CROSS JOIN c),
o AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (alone) AS unique_fails,
  sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM o"""

ORACLE = {"op4_quality_rules": QUALITY, "op5_mixing": MIXING, "op9_line_dedup": LINES, "op12_filter_audit": AUDIT}
