"""DuckDB SQL for the operators that SQL can express; written from the contracts, over the whole tables."""

OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least_of AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT doc_id, i FROM win JOIN least_of USING (g) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY ALL),
island AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
factor AS (SELECT doc_id, max(i) - min(i) + 13 AS size FROM island GROUP BY doc_id, k),
factors AS (SELECT doc_id, count(*) AS n_factors, max(size) AS longest_factor FROM factor GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256,
       coalesce(n_factors, 0)::BIGINT AS n_factors, coalesce(longest_factor, 0)::BIGINT AS longest_factor
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN factors USING (doc_id)
"""

_MIX = r"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM docs),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
c AS (SELECT *, [5.0, 2.0, 1.0][turn + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, 0.5::DOUBLE * (turn - 1) AS slope FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM c) - coalesce((SELECT sum(cap) FROM c b WHERE b.cap / b.weight < c.cap / c.weight), 0))
              / ((SELECT sum(weight) FROM c) - coalesce((SELECT sum(weight) FROM c b WHERE b.cap / b.weight < c.cap / c.weight), 0)) AS level FROM c),
t AS (SELECT source, source_size, slope, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level) * weight, cap)) AS target FROM l),
o AS (SELECT d.*, t.source_size, t.target, t.slope, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM o),
x AS (SELECT *, floor(ratio + 1e-12) * size + greatest(0, least(greatest(0, round((ratio - floor(ratio + 1e-12)) * source_size)) - start, size)) AS take FROM r)
"""
OP8 = rf"""
WITH docs AS (SELECT doc_id, source, text FROM documents), {_MIX}
SELECT doc_id, size, source_size, target, take::BIGINT AS taken,
       round(abs(CASE WHEN take > 0 THEN CASE WHEN slope = 0 THEN start / target ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target))) / (2 * slope) END END), 9) AS position
FROM x
"""

_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9 = rf"""
WITH w AS (SELECT doc_id, {_FOLD} AS ws FROM documents),
b AS (SELECT item_id, {_FOLD} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM
       (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES = {"op2_substring_dedup": OP2, "op8_curriculum_mix": OP8, "op9_decontaminate": OP9}
