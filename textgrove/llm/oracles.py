"""SQL restatements of the queries that SQL can express, for DuckDB over the same tables.

Fingerprints by XXH64, merges by rank, trained models and keyed surrogates cannot be written in
SQL; those queries are tested against brute force.
"""

from __future__ import annotations

OP3 = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(lower_ascii, '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
    FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)
),
doc_words AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower_ascii, '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
),
windows AS MATERIALIZED (
    SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS gram
    FROM (SELECT item_id, words, least(10, len(words)) AS k,
        unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM item_words WHERE len(words) > 0)
),
lengths AS (SELECT DISTINCT k FROM windows),
spots AS (
    SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM doc_words, lengths WHERE len(words) >= k
),
hits AS MATERIALIZED (
    SELECT r, i, s.k, item_id
    FROM (SELECT r, i, k, array_to_string(words[i : i + k - 1], ' ') AS gram FROM spots) s
    JOIN windows w ON s.k = w.k AND s.gram = w.gram
),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""

OP8 = r"""
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
split AS (
    SELECT row_number() OVER () AS r, page_id,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
parts AS (
    SELECT r, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM split
),
fitting AS (
    SELECT r, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (r)
"""

OP11 = r"""
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS MATERIALIZED (
    SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(
        CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.r <> b.r WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
        row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP12 = r"""
WITH RECURSIVE crc_step(i, k, v) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS crc FROM crc_step WHERE k = 8),
docs AS (
    SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS check_sum
    FROM documents, crc_table
),
leaves AS (
    SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen((n_chars + (check_sum % 7 = 0)::INT)::VARCHAR) || ':' || (n_chars + (check_sum % 7 = 0)::INT), '-')
            || tail) AS copy
    FROM docs
),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves
),
nodes(lang, level, n, idx, d) AS (
    SELECT lang, 0, n, idx, leaf FROM placed
    UNION ALL
    SELECT lang, level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(d, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY lang, level, n, idx // 2
),
subroots AS (
    SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
),
upper_nodes(level, n, idx, d) AS (
    SELECT 0, n, idx, d FROM subroots
    UNION ALL
    SELECT level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(d, '' ORDER BY idx))
    FROM upper_nodes WHERE n > 1 GROUP BY level, n, idx // 2
),
walk(r, lang, level, n, idx, proof, folded) AS (
    SELECT r, lang, 0, n, idx, '', copy FROM placed
    UNION ALL
    SELECT w.r, w.lang, w.level + 1, (w.n + 1) // 2, w.idx // 2, w.proof || coalesce(s.d, ''),
        sha256(CASE WHEN w.idx % 2 = 1 THEN s.d || w.folded ELSE w.folded || coalesce(s.d, '') END)
    FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.idx = xor(w.idx, 1)
    WHERE w.n > 1
),
climb(r, level, n, idx, proof, folded) AS (
    SELECT w.r, 0, s.n, s.idx, w.proof, w.folded FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
    UNION ALL
    SELECT w.r, w.level + 1, (w.n + 1) // 2, w.idx // 2, w.proof || coalesce(s.d, ''),
        sha256(CASE WHEN w.idx % 2 = 1 THEN s.d || w.folded ELSE w.folded || coalesce(s.d, '') END)
    FROM climb w LEFT JOIN upper_nodes s ON s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1
)
SELECT p.doc_id, p.leaf, s.d AS subroot, u.d AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = u.d AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
JOIN climb c ON c.r = p.r AND c.n = 1
CROSS JOIN (SELECT d FROM upper_nodes WHERE n = 1) u
"""

ORACLES = {"op3_decontaminate": OP3, "op8_url_rules": OP8, "op11_hard_negatives": OP11, "op12_merkle": OP12}
