"""SQL twins of the queries that SQL can express, by comparing everything with everything: for small tables."""

from __future__ import annotations

from .common import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"
_REACH = "reach(a, b) AS (SELECT x, y FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x)"

MIX = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('42|' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
c AS (SELECT *, source_size * 2.0 AS cap, source_size * 2.0 / weight AS ratio, sum(source_size) OVER () * 1.5 AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT max(level) FROM l WHERE level <= ratio)), cap) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS repeats FROM t),
o AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.repeats, greatest(0, round(g.target) - g.repeats * g.source_size) AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, size, source_size, CAST(target AS DOUBLE) AS target, CAST(repeats * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o"""

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k), {_REACH},
m AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, coalesce(m.least, d.doc_id) >= d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c != 0)) > 0),
k AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
edges AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k), {_REACH},
g AS (SELECT x, count(*) AS n FROM edges GROUP BY 1), m AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(g.n, 0) AS n_links, least(e.vec_id, coalesce(m.least, e.vec_id)) AS component_id, coalesce(m.least, e.vec_id) >= e.vec_id AS kept FROM embeddings e LEFT JOIN g ON g.x = e.vec_id LEFT JOIN m ON m.a = e.vec_id"""
