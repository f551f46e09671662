"""DuckDB SQL of the training-text queries that SQL can express."""

from __future__ import annotations

_SHINGLES = (
    "WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM kb_documents), "
    "s AS (SELECT id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS s FROM t WHERE len(w) >= 30), "
    "u AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s) "
)

# five words and 0.8, over classes of equal word sequences
_CLASSES = (
    "WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM kb_documents), m AS (SELECT id, w, min(id) OVER (PARTITION BY w) AS class_id FROM t WHERE len(w) >= 30), "
    "s AS (SELECT class_id, list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) AS s FROM m WHERE id = class_id), u AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM s), "
    "p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.class_id < b.class_id GROUP BY ALL), l AS (SELECT a, b, common / (na + nb - common)::DOUBLE AS share FROM p WHERE common >= 0.8::DOUBLE * (na + nb - common)) "
)
_SECTIONS = (
    "WITH d AS (SELECT DISTINCT id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS c FROM kb_documents WHERE regexp_matches(lower(path), '\\.(md|mdx|markdown)$')), "
    "l AS (SELECT id, unnest(c) AS line, generate_subscripts(c, 1) AS n FROM d), f AS (SELECT *, starts_with(line, '```') AS mark, sum(starts_with(line, '```')::INT) OVER (PARTITION BY id ORDER BY n) AS m FROM l), "
    "g AS (SELECT id, n, line, NOT mark AND m % 2 = 0 AS plain, regexp_matches(line, '^#{1,6}[ \\t]+\\S') AS hashes, regexp_matches(line, '^(=+|-+)[ \\t]*$') AS under FROM f), "
    "h AS (SELECT *, plain AND hashes AS atx, plain AND NOT hashes AND trim(line) <> '' AND NOT under AND coalesce(lead(under) OVER w, false) AS text_over, coalesce(lag(trim(line) = '' OR plain AND hashes) OVER w, true) AS free FROM g WINDOW w AS (PARTITION BY id ORDER BY n)), "
    "i AS (SELECT *, text_over AND free AS one FROM h), j AS (SELECT *, one OR text_over AND coalesce(lag(one, 2) OVER (PARTITION BY id ORDER BY n), false) AS setext FROM i), "
    "k AS (SELECT *, coalesce(lag(setext) OVER (PARTITION BY id ORDER BY n), false) AS rule, sum((atx OR setext)::INT) OVER (PARTITION BY id ORDER BY n) AS section_no FROM j) "
)

ORACLES: dict[str, str] = {
    "p5_found": _SHINGLES
    + "SELECT id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY ALL) WHERE common >= 0.6::DOUBLE * (na + nb - common)",
    "p5_classes": _CLASSES
    + ", e AS (SELECT c, count(*) AS k FROM (SELECT a AS c FROM l UNION ALL SELECT b FROM l) GROUP BY c) SELECT id, class_id, coalesce(k, 0)::BIGINT AS links FROM m LEFT JOIN e ON e.c = m.class_id",
    "p5_links": _CLASSES + "SELECT a AS class_a, b AS class_b, round(share, 6) AS similarity FROM l",
    "p6_found": _SECTIONS
    + "SELECT id AS document_id, section_no::BIGINT AS section_no FROM k WHERE NOT (atx OR setext OR rule) GROUP BY id, section_no HAVING length(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) > (SELECT amount FROM size_limits WHERE limit_name = 'chunk_size')",
}
