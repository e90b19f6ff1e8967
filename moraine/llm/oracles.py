"""SQL for DuckDB of those corpus queries that SQL can express."""

from __future__ import annotations

from .mixing import LACK, STEP, STEP_20

#: op1_mix_sources: the same targets, slots and shuffled streams by plain windows over whole tables.
MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * source_size AS lim FROM s0),
s2 AS (SELECT *, CAST(CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s1),
s3 AS (SELECT *, lim * sum(weight) OVER (ORDER BY lim / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS stops FROM s2),
s4 AS (SELECT sid, source, source_size, total, CASE WHEN stops THEN CAST(lim AS DOUBLE)
        ELSE CAST((total - coalesce(sum(CASE WHEN stops THEN lim END) OVER (), 0)) * weight AS DOUBLE) / CAST(sum(CASE WHEN NOT stops THEN weight END) OVER () AS DOUBLE) END AS target FROM s3),
p AS (SELECT total, greatest(16, least(4096, total // (512 * greatest(1, n)))) AS block FROM (SELECT max(total) AS total, count(*) AS n FROM s4)),
h AS (SELECT sid, sum(target / total) OVER (ORDER BY sid) AS hi FROM s4 WHERE target > 0),
iv AS (SELECT sid, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, CASE WHEN lead(sid) OVER (ORDER BY sid) IS NULL THEN 2 ELSE hi END AS hi FROM h),
i AS (SELECT unnest(range(1, (total + block - 1) // block + 1)) AS i FROM p),
f AS (SELECT (i >> 20) * CAST({STEP_20!r} AS DOUBLE) AS a, (i & 1048575) * CAST({STEP!r} AS DOUBLE) AS b FROM i),
g AS (SELECT (a - floor(a)) + (b - floor(b)) AS x FROM f),
takes AS (SELECT sid, count(*) AS n FROM (SELECT x - floor(x) AS x FROM g) JOIN iv ON x >= lo AND x < hi GROUP BY sid),
g0 AS (SELECT s4.*, coalesce(n, 0) * block AS given, CAST(round(target) AS BIGINT) AS goal FROM s4 LEFT JOIN takes USING (sid) CROSS JOIN p),
pl AS (SELECT *, CASE WHEN (goal - given) * {LACK} > goal THEN goal ELSE least(given, goal) END AS length FROM g0),
st AS (SELECT d.doc_id, d.size, pl.source_size, pl.target, pl.length, d.source,
        coalesce(sum(d.size) OVER (PARTITION BY pl.sid ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':42'), doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
       FROM d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source)
SELECT doc_id, size, source_size, target, CAST(
        greatest(0, least(start + size, length) - start) + greatest(0, least(source_size + start + size, length) - source_size - start)
        + greatest(0, least(2 * source_size + start + size, length) - 2 * source_size - start) AS BIGINT) AS taken, source FROM st
"""

#: op2_decontaminate: every shingle of every document joined with those of the items.
HELD = r"""
WITH i0 AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM i0),
i2 AS (SELECT item_id, text, w, least(5, len(w)) AS n FROM i1 WHERE len(w) > 0),
i3 AS (SELECT DISTINCT item_id, text, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i2)),
i4 AS (SELECT *, count(*) OVER (PARTITION BY item_id, text) AS n_item FROM i3),
d1 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
d2 AS (SELECT r, doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d1 CROSS JOIN (SELECT DISTINCT n FROM i2)),
d3 AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM d2)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d3 JOIN i4 USING (n, s) GROUP BY r, doc_id, item_id, text, n_item HAVING count(*) >= 0.8 * n_item
"""
