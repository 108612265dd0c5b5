"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(d, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to, true AS intact
FROM m
""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i : i + 2], chr(10)) AS win FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w WHERE regexp_matches(win, '\S')) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 2)) AS i FROM again),
n AS (SELECT doc_id, count(*) AS n_removed, list(i) AS r FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(l) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN r IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(r, i)) END, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
""",
    "op9_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM d),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS rep FROM s WHERE len(g) > 0 GROUP BY 1),
e AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk(node, root) AS (SELECT rep, rep FROM c UNION SELECT both_ways.b, walk.root FROM walk JOIN both_ways ON walk.node = both_ways.a),
comp AS (SELECT node, min(root) AS component_id FROM walk GROUP BY node),
named AS (SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
          FROM s LEFT JOIN c ON c.g = list_sort(s.g) LEFT JOIN comp ON comp.node = c.rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM named
""",
    "op11_vector_codes": r"""
WITH RECURSIVE ok AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
     WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
width AS (SELECT len(x) // 16 AS k FROM ok LIMIT 1),
p AS (SELECT ok.*, part, list_slice(x, part * k + 1, part * k + k) AS v FROM ok, width, (SELECT unnest(generate_series(0, 15)) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM ok ORDER BY vec_id LIMIT 64)),
b0 AS MATERIALIZED (SELECT part, e, v AS c FROM p JOIN first USING (vec_id)),
a0 AS MATERIALIZED (SELECT vec_id, p.part, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM p JOIN b0 ON p.part = b0.part GROUP BY 1, 2),
s0 AS (SELECT part, CAST(m % 64 AS INT) AS e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT a0.*, unnest(generate_series(1, len(v))) AS i FROM a0) GROUP BY 1, 2, 3),
b1 AS MATERIALIZED (SELECT part, e, coalesce(n.c, b0.c) AS c FROM b0 LEFT JOIN (SELECT part, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM s0 GROUP BY 1, 2) n USING (part, e)),
a1 AS MATERIALIZED (SELECT vec_id, p.part, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM p JOIN b1 ON p.part = b1.part GROUP BY 1, 2),
s1 AS (SELECT part, CAST(m % 64 AS INT) AS e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT a1.*, unnest(generate_series(1, len(v))) AS i FROM a1) GROUP BY 1, 2, 3),
b2 AS MATERIALIZED (SELECT part, e, coalesce(n.c, b1.c) AS c FROM b1 LEFT JOIN (SELECT part, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM s1 GROUP BY 1, 2) n USING (part, e)),
a2 AS MATERIALIZED (SELECT vec_id, p.label, p.part, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM p JOIN b2 ON p.part = b2.part GROUP BY 1, 2, 3),
r AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(m % 64 AS INT)), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY 1, 2),
d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r, d
""",
    "op12_near_vectors": r"""
WITH RECURSIVE ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings
     WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id != b.vec_id WHERE list_dot_product(a.v, b.v) / a.norm / b.norm >= 0.93),
walk(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, walk.root FROM walk JOIN l ON walk.node = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT node, min(root) AS component_id FROM walk GROUP BY node)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""",
}
