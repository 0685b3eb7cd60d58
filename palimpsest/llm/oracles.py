"""DuckDB SQL of the results that SQL can state: by definition, not by method. Others are tested by brute force in tests/llm."""

# Bytes are pairs of hexadecimal digits; a string of 50 bytes that starts in a document with a smaller doc_id covers 50 bytes.
REPEATS = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
pieces AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0), 1000)) AS base FROM d),
parts AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 1049) AS part FROM pieces),
starts AS (SELECT doc_id, base, part, unnest(range(0, least(1000, len(part) // 2 - 49))) AS off FROM parts),
windows AS (SELECT doc_id, base + off AS p, substr(part, 2 * off + 1, 100) AS w FROM starts),
least_id AS (SELECT w, min(doc_id) AS m FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM windows JOIN least_id USING (w) WHERE m < doc_id),
edges AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edges),
spans AS (SELECT doc_id, k, min(p) AS s, max(p) + 50 AS e FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, k, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM spans),
cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY k) AS head FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

NEAR_DUPLICATES = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS sh FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(root, node) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.root, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.node)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sizes s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""

# Survivors by definition: documents that none of the filters applied so far fails, for each of the 120 orders.
INTERACTIONS = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
words AS (SELECT doc_id, t, part, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
fails AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f FROM words),
known AS (SELECT f.doc_id, part, f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM fails f LEFT JOIN
  (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM known GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
grow(o) AS (SELECT '' UNION ALL SELECT o || l FROM grow, letters WHERE length(o) < 5 AND NOT contains(o, l)),
orders AS (SELECT o FROM grow WHERE length(o) = 5),
steps AS (SELECT o, step, substr(o, step, 1) AS l, substr(o, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
seen AS (SELECT part, o, step, l, f, n, good, toxic, contains(f, l) AS hit, length(translate(f, before, '')) < length(f) AS gone FROM counts, steps),
rows AS (SELECT part, o, step, l, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = l THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM seen GROUP BY part, o, step, l)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM rows
"""

SQL = {"op12_subset_zeta": INTERACTIONS, "op5_suffix_dedup": REPEATS, "op9_bottom_k_near_dedup": NEAR_DUPLICATES}
