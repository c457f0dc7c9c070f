"""DuckDB SQL that has to give the same rows as the corpus queries."""

from __future__ import annotations

from readlog.llm import quality_rules

_WORDS = r"""t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM t),
u AS (SELECT rid, doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)"""

SUBSTRING_DEDUP = f"""WITH {_WORDS.format(text="text")},
g AS (SELECT rid, doc_id, i, x, CASE WHEN count(*) OVER v = 50 THEN string_agg(x, ' ') OVER v END AS g FROM u
      WINDOW v AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
s AS (SELECT rid, i, x, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM g),
c AS (SELECT rid, i, x, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
r AS (SELECT rid, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (rid)"""

SUFFIX_DEDUP = """WITH t AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT rid, doc_id, regexp_extract_all(h, '..') AS xs FROM t) y),
g AS (SELECT rid, doc_id, i, x, CASE WHEN count(*) OVER v = 50 THEN string_agg(x, '') OVER v END AS g FROM b
      WINDOW v AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
s AS (SELECT rid, i, x, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM g),
c AS (SELECT rid, i, x, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
e AS (SELECT rid, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS starts FROM c),
r AS (SELECT rid, count(*) FILTER (gone) AS n, count(*) FILTER (starts) AS k, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN r USING (rid)"""

NEAR_DEDUP = f"""WITH RECURSIVE {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
g AS (SELECT doc_id, i, string_agg(x, ' ') OVER v AS g, count(*) OVER v AS n FROM u WINDOW v AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sh AS (SELECT DISTINCT doc_id, g FROM g WHERE n = 5 OR i = 1),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
lk AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
       JOIN sz m ON m.doc_id = p.a JOIN sz n ON n.doc_id = p.b WHERE 100 * c >= 75 * (m.n + n.n - c)),
ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
rc AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b),
cl AS (SELECT a AS doc_id, min(b) AS component_id FROM rc GROUP BY a)
SELECT d.doc_id, coalesce(sz.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN cl USING (doc_id) LEFT JOIN sz USING (doc_id)"""

MIXING = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(ord - 1) % 3 + 1] AS weight, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
f AS (SELECT *, sum(cap) OVER (ORDER BY source_size / weight, ord) - cap AS before, sum(weight) OVER (ORDER BY source_size / weight DESC, ord DESC) AS rest FROM w),
k AS (SELECT *, 100 * cap * rest <= weight * (150 * total - 100 * before) AS isfull FROM f),
t AS (SELECT source, source_size, CASE WHEN isfull THEN CAST(cap AS DOUBLE)
      ELSE CAST(weight AS DOUBLE) * (CAST(150 * total - 100 * coalesce(sum(cap) FILTER (isfull) OVER (), 0) AS DOUBLE) / CAST(100 * sum(weight) FILTER (NOT isfull) OVER () AS DOUBLE)) END AS target,
      greatest(1, CAST(ceil(source_size / 1000000.0) AS BIGINT)) AS n_shards, coalesce('s' || source, '') AS sid FROM k),
q AS (SELECT sid, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, sid) AS rn, (SELECT floor(sum(target) / 16) FROM t) AS seats FROM (SELECT sid, target, unnest(range(0, CAST(target / 16 AS BIGINT) + 30)) AS j FROM t) x),
b AS (SELECT sid, count(*) FILTER (rn <= seats) AS won FROM q GROUP BY sid),
p AS (SELECT d.*, t.sid, t.source_size, t.target, CAST('0x' || substr(key, 1, 8) AS BIGINT) % t.n_shards AS shard FROM d JOIN t ON t.sid = coalesce('s' || d.source, '')),
c AS (SELECT sid, shard, sum(size) AS shard_size FROM p GROUP BY 1, 2),
h AS (SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY shard_size / (2 * j + 1) DESC, shard) AS rn FROM (SELECT sid, shard, shard_size, unnest(range(0, CAST(shard_size / 8 AS BIGINT) + 30)) AS j FROM c) x),
e AS (SELECT c.sid, c.shard, c.shard_size, least(2 * c.shard_size, 16 * (SELECT count(*) FROM h WHERE h.sid = c.sid AND h.shard = c.shard AND rn <= (SELECT won FROM b WHERE b.sid = c.sid))) AS quota FROM c),
o AS (SELECT p.*, e.shard_size, e.quota, CASE WHEN e.shard_size > 0 THEN e.quota // e.shard_size ELSE 0 END AS passes, sum(size) OVER (PARTITION BY p.sid, p.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM p JOIN e ON e.sid = p.sid AND e.shard = p.shard)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, quota - passes * shard_size - before)) AS BIGINT) AS taken FROM o"""

SQL = {
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op4_minhash": NEAR_DEDUP,
    "op5_mixing": MIXING,
    "op8_quality_rules": quality_rules.ORACLE,
    "op10_substring_dedup": SUBSTRING_DEDUP,
}
