"""The query catalogue of the core operators, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import evaluation
from lodestrata.functions import redaction as X
from lodestrata.functions import text as T
from lodestrata.functions.embedding import KeywordEmbedder
from lodestrata.operators import chunking, crawl, evidence, fusion, lookup, retrieve, store
from lodestrata.session import table
from lodestrata.sources import files, webpages

QUERY = "rebuild evidence threshold"
IDENTIFIER = "sortTranscriptLantern"
ABSENT = "evid ebuil"
EMBEDDER = KeywordEmbedder(("vector", "retriever", "token", "evidence", "cache", "rebuild"))
VECTOR = EMBEDDER.embed_query(QUERY)
LIMIT = 8

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kb_documents").dropDuplicates(["id"])


def chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks with their document's place, as the retrievers read them; late-arriving copies count once."""
    c = table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "section", "content").dropDuplicates(["chunk_id"])
    places = documents(s, d).select(F.col("id").alias("document_id"), "source_key", "source_kind", "path")
    return c.join(places, "document_id").withColumn("embedding", EMBEDDER.embed(F.col("content")))


# --- SQL pieces -----------------------------------------------------------------------------------

_D = "d AS (SELECT DISTINCT id, source_key, source_kind, path FROM kb_documents)"
_CK = f"{_D}, c AS (SELECT DISTINCT id, document_id, section, content FROM chunks), ck AS (SELECT c.id AS chunk_id, document_id, path, section, content, source_key, source_kind FROM c JOIN d ON d.id = c.document_id)"


def _suffix_sql(suffixes: list[str]) -> str:
    return "(" + " OR ".join(f"lower(path) LIKE '%{s}'" for s in suffixes) + ")" if suffixes else "true"


def _sum(parts: list[str], empty: str = "0") -> str:
    return " + ".join(parts) if parts else empty


def _knn_sql(query: str, most: int, suffixes: list[str]) -> str:
    q = EMBEDDER.embed_query(query)
    squares = _sum([f"pow((CASE WHEN contains(lower(content), '{w}') THEN 10.0 ELSE 0.0 END) - {x}, 2)" for w, x in zip(EMBEDDER.words, q)])
    return f"SELECT chunk_id, distance, CAST(row_number() OVER (ORDER BY distance, chunk_id) AS INT) AS rank FROM (SELECT chunk_id, round(sqrt({squares}), 12) AS distance FROM ck WHERE {_suffix_sql(suffixes)}) QUALIFY rank <= {most}"


def _fts_sql(query: str, most: int, suffixes: list[str]) -> str:
    terms = T.terms_of(query)[: T.QUERY_TOKENS]
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = _sum([f"greatest(1e-6, ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE))) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms))])
    return (
        f"SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (SELECT chunk_id, round({score}, 9) AS score FROM "
        f"(SELECT chunk_id, path, len(w) AS dl, {tf} FROM (SELECT chunk_id, path, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM ck)) t, "
        f"(SELECT count(*) AS n, avg(len(w)) AS avgdl, {df} FROM (SELECT w, {tf} FROM (SELECT regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM ck))) s "
        f"WHERE ({_sum([f'tf{i}' for i in range(len(terms))])}) > 0 AND {_suffix_sql(suffixes)}) QUALIFY rank <= {most}"
    )


def _match_sql(query: str, most: int, suffixes: list[str], fields: tuple[tuple[str, int], ...], terms: list[str]) -> str:
    hits = _sum([f"CAST(contains(lower(coalesce({f}, '')), '{t}') AS INT)" for t in terms for f, _ in fields])
    bonus = _sum([f"(CASE WHEN contains(lower(coalesce({f}, '')), '{query.strip().lower()}') THEN {n} ELSE 0 END)" for f, n in fields])
    return f"SELECT chunk_id, quality, CAST(row_number() OVER (ORDER BY quality DESC, chunk_id) AS INT) AS rank FROM (SELECT chunk_id, {hits} + {bonus} AS quality FROM ck WHERE {_suffix_sql(suffixes)} AND ({hits}) > 0) QUALIFY rank <= {most}"


def _like_sql(query: str, most: int, suffixes: list[str]) -> str:
    return _match_sql(query, most, suffixes, (("content", 100),), T.terms_of(query)[: T.QUERY_TOKENS])


def _meta_sql(query: str, most: int, suffixes: list[str]) -> str:
    return _match_sql(query, most, suffixes, (("path", 100), ("section", 80)), T.terms_of(query))


def _candidates_sql(query: str, limit: int, suffixes: list[str]) -> str:
    most = fusion.ladder(limit)[-1]
    counts = ", ".join(f"count(*) FILTER (WHERE least(coalesce(v, 1e9), coalesce(f, 1e9), coalesce(l, 1e9), coalesce(m, 1e9)) <= {s}) AS n{s}" for s in fusion.ladder(limit))
    step = "CASE " + " ".join(f"WHEN n{s} >= {limit} THEN {s}" for s in fusion.ladder(limit)[:-1]) + f" ELSE {most} END"
    return (
        f"v1 AS ({_knn_sql(query, most, suffixes)}), f1 AS ({_fts_sql(query, most, suffixes)}), l1 AS (SELECT * FROM ({_like_sql(query, most, suffixes)}) WHERE (SELECT count(*) FROM f1) = 0), "
        f"m1 AS ({_meta_sql(query, most, suffixes)}), ids AS (SELECT chunk_id FROM v1 UNION SELECT chunk_id FROM f1 UNION SELECT chunk_id FROM l1 UNION SELECT chunk_id FROM m1), "
        "cand AS (SELECT ids.chunk_id, v1.rank AS v, f1.rank AS f, l1.rank AS l, m1.rank AS m FROM ids LEFT JOIN v1 USING (chunk_id) LEFT JOIN f1 USING (chunk_id) LEFT JOIN l1 USING (chunk_id) LEFT JOIN m1 USING (chunk_id)), "
        f"st AS (SELECT CAST({step} AS INT) AS step FROM (SELECT {counts} FROM cand)), "
        "cut AS (SELECT chunk_id, CASE WHEN v <= step THEN v END AS v, CASE WHEN f <= step THEN f END AS f, CASE WHEN l <= step THEN l END AS l, CASE WHEN m <= step THEN m END AS m, step FROM cand, st "
        "WHERE least(coalesce(v, 1e9), coalesce(f, 1e9), coalesce(l, 1e9), coalesce(m, 1e9)) <= step)"
    )


def _coverage_sql(field: str, terms: list[str]) -> str:
    return f"({_sum([f'CAST(contains({field}, {chr(39)}{t}{chr(39)}) AS INT)' for t in terms])}) / {float(len(terms))}::DOUBLE"


def _boost_sql(query: str) -> str:
    packed, terms = T.compact_literal(query), T.terms_of(query)
    place = "regexp_replace(lower(path || ' ' || coalesce(section, '')), '[^\\p{L}\\p{N}]+', '', 'g')"
    body = "regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', '', 'g')"
    return f"(CASE WHEN contains({place}, '{packed}') THEN 0.03 WHEN contains({body}, '{packed}') THEN 0.012 ELSE 0.0 END)::DOUBLE + 0.02::DOUBLE * {_coverage_sql(place, terms)} + 0.008::DOUBLE * {_coverage_sql(body, terms)}"


def _rrf(c: str) -> str:
    return f"coalesce(1.0::DOUBLE / (60 + {c}), 0.0::DOUBLE)"


def _search_sql(query: str, limit: int, suffixes: list[str]) -> str:
    score = f"{_rrf('v')} + {_rrf('f')} + {_rrf('l')} + ({_boost_sql(query)})"
    return (
        f"WITH {_CK}, {_candidates_sql(query, limit, suffixes)} SELECT chunk_id, document_id, source_key, path, section, round(score, 9) AS score FROM "
        f"(SELECT ck.*, round({score}, 12) AS score FROM ck JOIN cut USING (chunk_id)) ORDER BY score DESC, document_id, chunk_id LIMIT {limit}"
    )


# --- retrieval ------------------------------------------------------------------------------------


@register("vector_knn", f"WITH {_CK} {_knn_sql(QUERY, 50, [])}")
def _(s, d):
    return retrieve.vector_knn(chunks(s, d), VECTOR, 50)


@register("vector_knn_filtered", f"WITH {_CK} {_knn_sql(QUERY, 20, ['.md', '.go'])}")
def _(s, d):
    return retrieve.vector_knn(chunks(s, d), VECTOR, 20, [".md", ".go"])


@register(
    "embedding_neighbours",
    "WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM "
    "(SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(range(1, len(qe) + 1), lambda i: (embedding[i]::DOUBLE - qe[i]::DOUBLE) * (embedding[i]::DOUBLE - qe[i]::DOUBLE)))), 6) AS distance FROM embeddings, q) QUALIFY rank <= 10",
)
def _(s, d):
    """A stated query set against all vectors, in blocks."""
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    return retrieve.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


@register("fts_bm25", f"WITH {_CK} {_fts_sql(QUERY, 50, [])}")
def _(s, d):
    return retrieve.full_text(chunks(s, d), QUERY, 50)


@register("fts_bm25_filtered", f"WITH {_CK} {_fts_sql(QUERY, 20, ['.py', '.ts'])}")
def _(s, d):
    return retrieve.full_text(chunks(s, d), QUERY, 20, [".py", ".ts"])


@register("fts_bm25_indexed", f"WITH {_CK} {_fts_sql(QUERY, 50, [])}")
def _(s, d):
    c = chunks(s, d)
    return retrieve.full_text_indexed(retrieve.postings(c), retrieve.lengths(c), QUERY, 50)


@register("postings", f"WITH {_CK} SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM ck) GROUP BY ALL")
def _(s, d):
    return retrieve.postings(chunks(s, d))


@register("like_fallback", f"WITH {_CK} {_like_sql(ABSENT, 50, [])}")
def _(s, d):
    return retrieve.substring_match(chunks(s, d), ABSENT, 50)


@register("metadata_like", f"WITH {_CK} {_meta_sql(QUERY, 50, [])}")
def _(s, d):
    return retrieve.path_section_match(chunks(s, d), QUERY, 50)


@register("search_hybrid", _search_sql(QUERY, LIMIT, []))
def _(s, d):
    return fusion.search(chunks(s, d), QUERY, VECTOR, LIMIT).select("chunk_id", "document_id", "source_key", "path", "section", F.round("score", 9).alias("score"))


@register("search_hybrid_ext", _search_sql(QUERY, LIMIT, [".md", ".py"]))
def _(s, d):
    return fusion.search(chunks(s, d), QUERY, VECTOR, LIMIT, ["MD", " .py ", "a b"]).select("chunk_id", "document_id", "source_key", "path", "section", F.round("score", 9).alias("score"))


@register("search_fallback", _search_sql(ABSENT, LIMIT, []))
def _(s, d):
    return fusion.search(chunks(s, d), ABSENT, EMBEDDER.embed_query(ABSENT), LIMIT).select("chunk_id", "document_id", "source_key", "path", "section", F.round("score", 9).alias("score"))


# an identifier that stands in the chunks, one that doesn't, and a query that is none
_GUARDED = ("recordSource", "qzxvkWqkjzXzqv", "evidence threshold")


def _guard_sql(query: str) -> str:
    """Ids of the results, none where an identifier has vector hits only; whether it is one is said by patterns here."""
    lexical = "(SELECT count(f) + count(l) + count(m) FROM cut)"
    packed = f"length(regexp_replace(lower('{query}'), '[^a-z0-9]', '', 'g')) >= 8"
    shape = f"NOT regexp_matches('{query}', '\\s') AND {packed} AND (regexp_matches('{query}', '[0-9_./-]') OR (regexp_matches('{query}', '[a-z]') AND regexp_matches('{query}', '[A-Z]')))"
    score = f"{_rrf('v')} + {_rrf('f')} + {_rrf('l')} + ({_boost_sql(query)})"
    return (
        f"(WITH {_CK}, {_candidates_sql(query, LIMIT, [])} SELECT '{query}' AS query, chunk_id, document_id FROM (SELECT ck.*, round({score}, 12) AS score FROM ck JOIN cut USING (chunk_id)) "
        f"WHERE NOT ({shape}) OR {lexical} > 0 ORDER BY score DESC, document_id, chunk_id LIMIT {LIMIT})"
    )


@register("identifier_guard", " UNION ALL ".join(f"SELECT * FROM {_guard_sql(q)}" for q in _GUARDED))
def _(s, d):
    parts = [fusion.search(chunks(s, d), q, EMBEDDER.embed_query(q), LIMIT).select(F.lit(q).alias("query"), "chunk_id", "document_id") for q in _GUARDED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("rrf_fusion", f"WITH {_CK}, {_candidates_sql(QUERY, LIMIT, [])} SELECT chunk_id, v, f, l, m, round({_rrf('v')} + {_rrf('f')} + {_rrf('l')}, 9) AS rrf FROM cut")
def _(s, d):
    found = fusion.at_step(fusion.ranks(chunks(s, d), QUERY, VECTOR, fusion.ladder(LIMIT)[-1], []), LIMIT)
    return found.select("chunk_id", "v", "f", "l", "m", F.round(fusion.reciprocal(F.col("v")) + fusion.reciprocal(F.col("f")) + fusion.reciprocal(F.col("l")), 9).alias("rrf"))


@register("query_boost", f"WITH {_CK} SELECT chunk_id, round({_boost_sql(QUERY)}, 9) AS boost FROM ck")
def _(s, d):
    return chunks(s, d).select("chunk_id", F.round(fusion.boost(QUERY), 9).alias("boost"))


@register(
    "candidate_ladder",
    f"WITH {_CK}, {_candidates_sql(QUERY, LIMIT, [])} SELECT count(v) AS vector_candidates, count(f) AS fts_candidates, count(l) AS lexical_candidates, count(m) AS metadata_candidates, "
    "concat_ws(',', CASE WHEN count(v) > 0 THEN 'vector' END, CASE WHEN count(f) > 0 THEN 'fts' END, CASE WHEN count(l) > 0 THEN 'lexical' END, CASE WHEN count(m) > 0 THEN 'metadata' END) AS retrievers_used, count(v) + count(f) + count(l) > 0 AS rrf_used FROM cut",
)
def _(s, d):
    return fusion.diagnostics(chunks(s, d), QUERY, VECTOR, LIMIT)


# --- text -----------------------------------------------------------------------------------------


@register("compact_text", "SELECT DISTINCT id, regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '', 'g') AS packed FROM kb_documents")
def _(s, d):
    return documents(s, d).select("id", T.compact(F.col("title")).alias("packed"))


@register(
    "search_terms",
    "SELECT DISTINCT id, array_to_string(list_distinct_in_order, ' ') AS terms FROM (SELECT id, list_filter(all_terms, lambda x, i: list_position(all_terms, x) = i)[1:12] AS list_distinct_in_order FROM "
    "(SELECT id, list_filter(flatten(list_transform(regexp_extract_all(path, '[\\p{L}\\p{N}_./-]+')[1:8], lambda t: list_concat([regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', '', 'g')], "
    "regexp_split_to_array(lower(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+')))), lambda x: length(x) >= 2) AS all_terms FROM kb_documents))",
)
def _(s, d):
    return documents(s, d).select("id", F.array_join(T.search_terms(F.col("path")), " ").alias("terms"))


_LINE = "trim(regexp_replace(content, '[\\s\\p{Z}]+', ' ', 'g'))"


@register("snippet_plain", f"SELECT id AS chunk_id, CASE WHEN length(line) <= 220 THEN line ELSE rtrim(substr(line, 1, 219)) || '…' END AS snippet FROM (SELECT DISTINCT id, {_LINE} AS line FROM chunks)")
def _(s, d):
    c = table(s, d, "chunks").dropDuplicates(["id"])
    return c.select(F.col("id").alias("chunk_id"), T.snippet(F.col("content")).alias("snippet"))


@register(
    "snippet_anchor",
    "SELECT id AS chunk_id, CASE WHEN n <= 220 THEN line ELSE (CASE WHEN st > 0 THEN '…' ELSE '' END) || trim(substr(line, st + 1, en - st)) || (CASE WHEN en < n THEN '…' ELSE '' END) END AS snippet FROM "
    "(SELECT id, line, n, least(n, b + 220) AS en, CASE WHEN least(n, b + 220) = n THEN greatest(0, n - 220) ELSE b END AS st FROM (SELECT id, line, length(line) AS n, greatest(0, strpos(lower(line), 'the source changes') - 1 - 77) AS b FROM "
    f"(SELECT DISTINCT id, {_LINE} AS line FROM chunks) WHERE contains(lower(line), 'the source changes')))",
)
def _(s, d):
    c = table(s, d, "chunks").dropDuplicates(["id"]).where(F.contains(F.lower(F.regexp_replace("content", r"[\s\p{Z}]+", " ")), F.lit("the source changes")))
    return c.select(F.col("id").alias("chunk_id"), T.snippet(F.col("content"), "the source changes").alias("snippet"))


@register("token_estimates", "SELECT DISTINCT id, CAST(greatest(1, ceil(length(content) / 4)) AS INT) AS token_estimate, sha256(content) AS content_hash FROM chunks")
def _(s, d):
    c = table(s, d, "chunks").dropDuplicates(["id"])
    return c.select("id", T.estimate_tokens(F.col("content")).alias("token_estimate"), T.content_hash(F.col("content")).alias("content_hash"))


# --- sources, chunking ----------------------------------------------------------------------------


@register("language_detect", "SELECT id, CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.LANGUAGES.items()) + " WHEN '' THEN 'text' ELSE ext END AS detected FROM (SELECT DISTINCT id, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext FROM kb_documents)")
def _(s, d):
    return documents(s, d).select("id", files.language(F.col("path")).alias("detected"))


# every third file stands in a skipped folder, every seventh is binary, every eleventh a link, every thirteenth blank
_SHAPED = (
    "SELECT id, CASE WHEN id % 3 = 0 THEN (['vendor', 'Node_Modules', 'deep/dist', ' build ', '.git'])[CAST(id % 5 AS INT) + 1] || '/' || path WHEN id % 17 = 0 THEN path || '.PNG' ELSE path END AS path, id % 11 = 0 AS symlink, "
    "CASE WHEN id % 13 = 0 THEN encode(' ' || chr(9) || chr(12288) || chr(10)) WHEN id % 7 = 0 THEN encode('a' || chr(0) || 'b') || encode(content) WHEN id % 19 = 0 THEN from_hex('FFD8FFE0') ELSE encode(content) END AS body "
    "FROM (SELECT DISTINCT id, path, content FROM kb_documents)"
)


@register(
    "skip_rules",
    "SELECT id, CASE WHEN symlink THEN 'symlink' WHEN list_has_any(segs, [" + ", ".join(f"'{x}'" for x in files.SKIPPED_FOLDERS) + "]) OR segs[-1] IN (" + ", ".join(f"'{x}'" for x in files.SKIPPED_FILES) + ") OR lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ("
    + ", ".join(f"'{x}'" for x in files.BINARY) + f") THEN 'ignored' WHEN octet_length(body) > {files.MOST_BYTES} THEN 'too_large' WHEN binary_like THEN 'binary' WHEN blank THEN 'empty' END AS reason FROM "
    "(SELECT id, path, symlink, body, list_transform(string_split(path, '/'), lambda x: lower(trim(x))) AS segs, id % 13 <> 0 AND (id % 7 = 0 OR id % 19 = 0) AS binary_like, id % 13 = 0 OR id % 7 <> 0 AND id % 19 <> 0 AND "
    f"(SELECT bool_and(trim(regexp_replace(k.content, '[\\s\\p{{Z}}]+', '', 'g')) = '') FROM kb_documents k WHERE k.id = t.id) AS blank FROM ({_SHAPED}) t)",
)
def _(s, d):
    i, path, content = F.col("id"), F.col("path"), F.col("content")
    folder = F.element_at(F.array(*map(F.lit, ("vendor", "Node_Modules", "deep/dist", " build ", ".git"))), (i % 5 + 1).cast("int"))
    body = F.when(i % 13 == 0, F.encode(F.lit(" \t\u3000\n"), "UTF-8")).when(i % 7 == 0, F.encode(F.concat(F.lit("a\u0000b"), content), "UTF-8")).when(i % 19 == 0, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.encode(content, "UTF-8"))
    rows = documents(s, d).select("id", F.when(i % 3 == 0, F.concat_ws("/", folder, path)).when(i % 17 == 0, F.concat(path, F.lit(".PNG"))).otherwise(path).alias("path"), (i % 11 == 0).alias("symlink"), body.alias("content"))
    return files.scan(rows.withColumn("length", F.octet_length("content").cast("long"))).select("id", "reason")


@register(
    "chunk_sliding",
    "WITH RECURSIVE t AS (SELECT DISTINCT id, trim(regexp_replace(content, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS s FROM kb_documents WHERE path LIKE '%.txt' AND content IS NOT NULL), "
    "w AS (SELECT id, s, 0 AS pos, 0 AS fin, -1 AS k FROM t WHERE length(s) > 0 UNION ALL SELECT id, s, nxt, en, k + 1 FROM (SELECT id, s, k, cur AS nxt, CASE WHEN ideal < n AND b > cur + 420 THEN b ELSE ideal END AS en, n FROM "
    "(SELECT id, s, k, cur, n, ideal, greatest(coalesce(ideal - nullif(strpos(reverse(substr(s, 1, ideal + 1)), chr(10)), 0) + 1, -1), coalesce(ideal - nullif(strpos(reverse(substr(s, 1, ideal + 1)), ' '), 0) + 1, -1)) AS b FROM "
    "(SELECT id, s, k, length(s) AS n, CASE WHEN k < 0 THEN 0 ELSE greatest(fin - 100, pos + 1) END AS cur, least(length(s), (CASE WHEN k < 0 THEN 0 ELSE greatest(fin - 100, pos + 1) END) + 700) AS ideal FROM w WHERE k < 0 OR fin < length(s))))) "
    "SELECT id AS document_id, CAST(k AS INT) AS chunk_index, trim(regexp_replace(substr(s, pos + 1, fin - pos), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS content FROM w WHERE k >= 0",
)
def _(s, d):
    return chunking.chunk(documents(s, d).where("path like '%.txt'").withColumn("language", F.lit("text")), 700, 100).select("document_id", "chunk_index", "content")


@register(
    "markdown_sections",
    "WITH l AS (SELECT id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM (SELECT DISTINCT id, path, content FROM kb_documents WHERE regexp_matches(lower(path), '[^/]\\.(md|mdx|markdown)$'))), "
    "h AS (SELECT *, regexp_full_match(rtrim(line, chr(13)), '#{1,6}\\s+.+') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY id ORDER BY n) AS section_no FROM h), "
    "b AS (SELECT id, any_value(path) AS path, section_no, max(CASE WHEN head THEN regexp_replace(regexp_extract(rtrim(line, chr(13)), '^#{1,6}\\s+(.+)$', 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') END) AS named, "
    "regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head), ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS body FROM s GROUP BY id, section_no) "
    "SELECT id, coalesce(named, string_split(path, '/')[-1]) AS section, length(body) AS n, md5(body) AS digest, count(*) AS times FROM b WHERE body <> '' GROUP BY ALL",
)
def _(s, d):
    rows = documents(s, d).where(chunking.is_markdown(F.col("path")) & F.col("content").isNotNull())
    made = rows.select("id", F.explode(chunking.sections_of(F.col("path"), F.col("content"))).alias("p")).select("id", "p.section", F.length("p.content").cast("long").alias("n"), F.md5(F.encode("p.content", "UTF-8")).alias("digest"))
    return made.groupBy("id", "section", "n", "digest").agg(F.count("*").alias("times"))


@register("chunk_documents")
def _(s, d):
    """Sections, declarations and windows of all documents."""
    return chunking.chunk(documents(s, d))


@register("chunk_counts_by_source", "SELECT source_key, count(*) AS n, CAST(sum(greatest(1, ceil(length(content) / 4))) AS BIGINT) AS tokens FROM (SELECT DISTINCT c.id, c.content, d.source_key FROM chunks c JOIN kb_documents d ON d.id = c.document_id) GROUP BY source_key")
def _(s, d):
    return chunks(s, d).groupBy("source_key").agg(F.count("*").alias("n"), F.sum(T.estimate_tokens(F.col("content"))).alias("tokens"))


_STITCHED = (
    "WITH RECURSIVE p AS (SELECT document_id, coalesce(content, '') AS c, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, content) AS n, count(*) OVER (PARTITION BY document_id) AS of_n FROM (SELECT DISTINCT document_id, chunk_index, content FROM chunks)), "
    "r AS (SELECT document_id, c AS text, n, of_n FROM p WHERE n = 1 UNION ALL SELECT r.document_id, CASE WHEN r.text = '' THEN p.c ELSE coalesce(r.text || substr(p.c, (SELECT max(k) FROM range(8, 1 + least(length(r.text), length(p.c))) t(k) WHERE substr(p.c, 1, k) = right(r.text, k)) + 1), "
    "r.text || chr(10) || chr(10) || p.c) END, p.n, r.of_n FROM r JOIN p ON p.document_id = r.document_id AND p.n = r.n + 1) SELECT document_id, text AS content FROM r WHERE n = of_n"
)


@register("stitch_documents", _STITCHED)
def _(s, d):
    return chunking.stitch(table(s, d, "chunks").select("document_id", "chunk_index", "content"))


# --- store ----------------------------------------------------------------------------------------


@register("get_by_id", "SELECT DISTINCT id, path, title, content FROM kb_documents WHERE id = 7")
def _(s, d):
    return documents(s, d).where("id = 7").select("id", "path", "title", "content")


@register("get_by_path", "SELECT DISTINCT id, source_key, path FROM kb_documents WHERE path = (SELECT min(path) FROM kb_documents) ORDER BY id")
def _(s, d):
    docs = documents(s, d)
    first = docs.agg(F.min("path").alias("path"))
    return docs.join(F.broadcast(first), "path").select("id", "source_key", "path").orderBy("id")  # one row


@register(
    "replace_source",
    "WITH r AS (SELECT DISTINCT id, source_key, path, content FROM kb_documents), k AS (SELECT min(source_key) AS k FROM r) SELECT id, source_key, path, length(content) AS n FROM r, k WHERE source_key <> k "
    "UNION ALL SELECT id + 1000000000, source_key, path, length(upper(content)) FROM r, k WHERE source_key = k AND id % 2 = 0",
)
def _(s, d):
    rows = documents(s, d).select("id", "source_key", "path", "content")
    key = rows.agg(F.min("source_key")).first()[0] or ""
    fresh = rows.where("id % 2 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "source_key", "path", F.upper("content").alias("content"))
    return store.replace_source(rows, key, fresh).select("id", "source_key", "path", F.length("content").cast("long").alias("n"))


@register("delete_source", "WITH r AS (SELECT DISTINCT id, source_key, path FROM kb_documents) SELECT id, source_key FROM r WHERE source_key <> (SELECT max(source_key) FROM r)")
def _(s, d):
    rows = documents(s, d).select("id", "source_key")
    return rows.join(rows.agg(F.max("source_key").alias("source_key")), "source_key", "left_anti").select("id", "source_key")


@register(
    "manifest_upsert",
    "WITH m AS (SELECT * FROM source_manifests), n AS (SELECT source_key || '/new' AS source_key, 'new' AS provider FROM m WHERE source_kind = 'web' UNION ALL SELECT source_key, 'again' FROM m WHERE source_kind <> 'web') "
    "SELECT coalesce(n.source_key, m.source_key) AS source_key, CASE WHEN n.source_key IS NOT NULL THEN n.provider ELSE m.provider END AS provider, CASE WHEN m.source_key IS NOT NULL THEN m.created_at ELSE '2026-01-01' END AS created_at, "
    "CASE WHEN m.source_key IS NOT NULL THEN m.last_rebuild_status ELSE 'idle' END AS last_rebuild_status, CASE WHEN m.source_key IS NOT NULL THEN m.last_rebuild_attempts ELSE 0 END AS last_rebuild_attempts FROM m FULL JOIN n ON m.source_key = n.source_key",
)
def _(s, d):
    m = table(s, d, "source_manifests")
    web = F.col("source_kind") == "web"
    fresh = m.withColumns({"provider": F.when(web, "new").otherwise("again"), "source_key": F.when(web, F.concat("source_key", F.lit("/new"))).otherwise(F.col("source_key")), "created_at": F.lit("2026-01-01")})
    return store.upsert_manifests(m, fresh).select("source_key", "provider", "created_at", "last_rebuild_status", "last_rebuild_attempts")


@register("failed_manifests", "SELECT source_key, last_rebuild_error, last_rebuild_attempts FROM source_manifests WHERE last_rebuild_status = 'failed'")
def _(s, d):
    return table(s, d, "source_manifests").where("last_rebuild_status = 'failed'").select("source_key", "last_rebuild_error", "last_rebuild_attempts")


@register(
    "db_stats",
    "SELECT (SELECT count(DISTINCT id) FROM kb_documents) AS documents, (SELECT count(DISTINCT id) FROM chunks) AS chunks, count(*) AS manifests, count(*) FILTER (WHERE last_rebuild_status = 'failed') AS failed FROM source_manifests",
)
def _(s, d):
    m = table(s, d, "source_manifests").agg(F.count("*").alias("manifests"), F.count_if(F.col("last_rebuild_status") == "failed").alias("failed"))
    n = documents(s, d).agg(F.count("*").alias("documents"))
    c = table(s, d, "chunks").select("id").distinct().agg(F.count("*").alias("chunks"))
    return n.crossJoin(c).crossJoin(m)  # one row each


_STATES = [("none", False, 0, None), ("failed", True, 2, "same"), ("failed_and_other", True, 1, "other"), ("missing", True, 0, None), ("changed", True, 0, "other"), ("current", True, 0, "same")]


@register(
    "index_state",
    "WITH c AS (SELECT * FROM (VALUES ('none', false, 0, NULL), ('failed', true, 2, 'same'), ('failed_and_other', true, 1, 'other'), ('missing', true, 0, NULL), ('changed', true, 0, 'other'), ('current', true, 0, 'same')) v(state, has_tables, failed, stored) "
    "UNION ALL SELECT 'stored', true, count(*) FILTER (WHERE last_rebuild_status = 'failed')::INT, 'same' FROM source_manifests) "
    "SELECT state, NOT has_tables OR failed > 0 OR stored IS DISTINCT FROM 'same' AS needs_rebuild, NOT has_tables OR stored IS DISTINCT FROM 'same' AS full_rebuild, "
    "CASE WHEN NOT has_tables THEN 'index bootstrap required' WHEN failed > 0 THEN 'one or more source rebuilds failed' WHEN stored IS NULL THEN 'embedding fingerprint missing' WHEN stored <> 'same' THEN 'embedding fingerprint changed' END AS reason FROM c",
)
def _(s, d):
    """All branches, and the state of the stored manifests."""
    failed = table(s, d, "source_manifests").where("last_rebuild_status = 'failed'").count()
    wanted = EMBEDDER.fingerprint().json()
    prints = {"same": wanted, "other": wanted | {"dimensions": 1}, None: None}
    got = [(name, store.index_state(has, n, prints[p], wanted)) for name, has, n, p in [*_STATES, ("stored", True, failed, "same")]]
    return s.createDataFrame([(n, g["needs_rebuild"], g["full"], g["reason"]) for n, g in got], "state string, needs_rebuild boolean, full_rebuild boolean, reason string")


@register("ingest_summary", "SELECT stage, reason, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM web_page_failures GROUP BY stage, reason")
def _(s, d):
    return table(s, d, "web_page_failures").groupBy("stage", "reason").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@register(
    "failure_reasons",
    "SELECT url, stage, CASE WHEN contains(lower(error), 'timeout') OR contains(lower(error), 'timed out') THEN 'timeout' WHEN contains(lower(error), 'too short') OR contains(lower(error), '内容过短') THEN 'too_short' WHEN contains(lower(error), 'json') THEN 'parse_error' ELSE 'fetch_error' END AS class FROM web_page_failures",
)
def _(s, d):
    return table(s, d, "web_page_failures").select("url", "stage", X.failure_reason(F.col("error")).alias("class"))


@register("token_usage", "SELECT doc_kind, sum(greatest(0, n_chars // 4))::BIGINT AS tokens, bool_or(lang IS NULL) AS estimated FROM documents GROUP BY doc_kind")
def _(s, d):
    return table(s, d, "documents").groupBy("doc_kind").agg(F.sum(F.greatest(F.lit(0), F.floor(F.col("n_chars") / 4))).cast("long").alias("tokens"), F.bool_or(F.col("lang").isNull()).alias("estimated"))


# --- redaction, URLs, crawl -----------------------------------------------------------------------


def _redacted_sql(url: str, fragment: bool) -> str:
    """Without re-encoding: values of the tables' parameters hold no escapes."""
    head = f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    authority = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    host = f"regexp_replace({authority}, '^.*@', '')"
    hosted = f"CASE WHEN {head} IN ('http', 'https', 'ftp', 'ws', 'wss') THEN lower({host}) ELSE {host} END"
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    pathed = f"CASE WHEN {path} = '' AND {head} IN ('http', 'https', 'ftp', 'ws', 'wss') THEN '/' ELSE {path} END"
    names = "|".join(X.SENSITIVE)
    query = f"regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1)"
    safe = f"regexp_replace({query}, '(^|&)({names})=[^&]+', '\\1\\2=[REDACTED]', 'gi')"
    part = f"regexp_extract({url}, '#(.*)$', 1)"
    shown = f"CASE WHEN {part} = '' THEN '' WHEN regexp_matches({part}, '[=&]') THEN '#' || regexp_replace({part}, '=[^&]+', '=[REDACTED]', 'g') ELSE '#[REDACTED]' END" if fragment else "''"
    return (
        f"CASE WHEN regexp_matches({url}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {head} || '://' || CASE WHEN regexp_matches({authority}, '.@') THEN '[REDACTED]@' ELSE '' END || {hosted} || {pathed} || CASE WHEN {query} = '' THEN '' ELSE '?' || {safe} END || {shown} ELSE {url} END"
    )


@register("redact_locators", f"SELECT DISTINCT id, {_redacted_sql('source_locator', True)} AS locator, {_redacted_sql('source_locator', False)} AS identity FROM kb_documents")
def _(s, d):
    return documents(s, d).select("id", X.redact_urls(F.col("source_locator")).alias("locator"), X.page_identity(F.col("source_locator")).alias("identity"))


@register("redact_contents")
def _(s, d):
    return documents(s, d).select("id", X.redact_text(F.col("content")).alias("content"))


_PATH_SQL = "coalesce(nullif(regexp_extract(final_url, '^[^/]*//[^/?#]*([^?#]*)', 1), ''), '/')"


@register(
    "chunk_paths",
    f"SELECT page_id, CASE WHEN p = '/' THEN 'index.md' WHEN regexp_matches(string_split(p, '/')[-1], '^.+\\.[^.]+$') THEN regexp_replace(p, '^/+', '') ELSE regexp_replace(p, '^/+', '') || '.md' END AS path FROM (SELECT DISTINCT page_id, {_PATH_SQL} AS p FROM web_fetched_pages)",
)
def _(s, d):
    return table(s, d, "web_fetched_pages").select("page_id", "final_url").distinct().select("page_id", X.chunk_path(F.col("final_url")).alias("path"))


_ROOT = "https://handbook.mistlewick.example/docs/"


@register(
    "url_scope_filter",
    f"SELECT page_id, lower(regexp_extract(final_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) = 'https://handbook.mistlewick.example' AND (starts_with(p, '/docs/') OR p = '/docs/') AS inside, "
    f"regexp_extract(lower(p), '\\.([a-z0-9]+)$', 1) IN ({', '.join(repr(x) for x in X.NON_HTML)}) OR lower(p) IN ('/robots.txt', '/sitemap.xml') OR {' OR '.join(f'starts_with(lower(p), {x!r})' for x in X.NOISE_PREFIXES)} AS excluded FROM (SELECT DISTINCT page_id, final_url, {_PATH_SQL} AS p FROM web_fetched_pages)",
)
def _(s, d):
    rows = table(s, d, "web_fetched_pages").select("page_id", "final_url").distinct()
    return rows.select("page_id", X.in_scope(F.col("final_url"), _ROOT).alias("inside"), X.excluded_by_default(F.col("final_url")).alias("excluded"))


@register(
    "crawl_bfs",
    "WITH RECURSIVE n AS (SELECT max(id) AS n FROM kb_documents), e AS (SELECT DISTINCT id AS src, (2 * id + 1) % n AS dst FROM kb_documents, n UNION SELECT id, (3 * id + 2) % n FROM kb_documents, n), "
    "r AS (SELECT 1::BIGINT AS page, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.page WHERE r.depth < 4) SELECT page, CAST(min(depth) AS INT) AS depth FROM r GROUP BY page",
)
def _(s, d):
    ids = documents(s, d).select("id")
    n = ids.agg(F.max("id").alias("n"))
    e = ids.crossJoin(F.broadcast(n)).select(F.col("id").alias("src"), F.posexplode(F.array((2 * F.col("id") + 1) % F.col("n"), (3 * F.col("id") + 2) % F.col("n"))).alias("position", "dst"))  # one row
    roots = s.createDataFrame([(1,)], "page long")
    return crawl.breadth_first(e.select("src", "dst", F.col("position").cast("long").alias("position")), roots, 5).select("page", "depth")


@register(
    "crawl_links",
    f"WITH RECURSIVE p AS (SELECT page_id, any_value(final_url) AS u, any_value(links) AS links FROM web_fetched_pages GROUP BY page_id), l AS (SELECT u, unnest(links) AS link FROM p WHERE links IS NOT NULL), "
    f"e AS (SELECT DISTINCT {_redacted_sql('u', False)} AS src, {_redacted_sql('link', False)} AS dst FROM l), o AS (SELECT min(u) AS u FROM p GROUP BY lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))), "
    f"r AS (SELECT DISTINCT {_redacted_sql('u', False)} AS page, 0 AS depth FROM o UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.page WHERE r.depth < 2) SELECT page, CAST(min(depth) AS INT) AS depth FROM r GROUP BY page",
)
def _(s, d):
    """Pages reached through the links of the fetched pages, starting at each site's first page."""
    pages = table(s, d, "web_fetched_pages").dropDuplicates(["page_id"])
    e = pages.where("links is not null").select(X.page_identity(F.col("final_url")).alias("src"), F.posexplode("links").alias("position", "dst"))
    edges = e.select("src", X.page_identity(F.col("dst")).alias("dst"), F.col("position").cast("long").alias("position"))
    roots = pages.groupBy(X.origin(F.col("final_url"))).agg(F.min("final_url").alias("page")).select(X.page_identity(F.col("page")).alias("page"))
    return crawl.breadth_first(edges, roots, 3).select("page", "depth")


# --- crawlers' replies ----------------------------------------------------------------------------

_NORMAL_SQL = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || CASE WHEN regexp_matches({u}, '^[^/]*//[^/?#]*/') THEN '' ELSE '/' END || regexp_replace(regexp_replace({u}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"
_PAGES_SQL = "SELECT page_id, any_value(requested_url) AS asked, any_value(final_url) AS final_url, any_value(title) AS title, any_value(markdown) AS markdown, any_value(links) AS links FROM web_fetched_pages GROUP BY page_id"


@register(
    "page_fields",
    f"WITH p AS (SELECT *, CASE WHEN page_id % 3 = 2 THEN asked ELSE final_url END AS u FROM ({_PAGES_SQL})) SELECT page_id, {_NORMAL_SQL.format(u='u')} AS url, coalesce(nullif(trim(title), ''), u) AS title, "
    "CASE WHEN page_id % 5 = 4 THEN '' ELSE coalesce(markdown, '') END AS markdown, array_to_string(list_transform(list_filter(coalesce(links, []), lambda x: regexp_matches(x, '^https?://[^/]')), lambda x: regexp_replace(x, '#.*$', '')), ' ') AS links FROM p",
)
def _(s, d):
    """Records in the shapes that crawlers give, made of the fetched pages, and parsed."""
    p = table(s, d, "web_fetched_pages").dropDuplicates(["page_id"])
    i, m = F.col("page_id"), F.col("markdown")
    part = lambda *cs: F.regexp_replace(F.regexp_replace(F.to_json(F.struct(*cs)), r"^\{", ""), r"\}$", "")
    text = F.when(i % 5 == 0, part(m)).when(i % 5 == 1, part(F.struct(m.alias("raw_markdown")).alias("markdown"))).when(i % 5 == 2, part(F.struct(m.alias("fit_markdown")).alias("markdown"))).when(i % 5 == 3, part(m.alias("raw_markdown")))
    url, title = F.col("final_url"), F.col("title")
    about = F.struct(F.when(i % 3 == 1, url).alias("url"), F.when(i % 2 == 0, title).alias("title"))
    place = F.when(i % 3 == 0, part(url.alias("url"), F.when(i % 2 == 1, title).alias("title"), about.alias("metadata"))).otherwise(part(F.when(i % 2 == 1, title).alias("title"), about.alias("metadata")))
    links = F.coalesce("links", F.array().cast("array<string>"))
    given = F.when(i % 2 == 0, part(F.struct(F.transform(links, lambda x: F.struct(x.alias("href"))).alias("internal")).alias("links"))).otherwise(part(F.struct(links.alias("external")).alias("links")))
    record = F.concat(F.lit("{"), F.array_join(F.filter(F.array(text, place, given), lambda x: x != ""), ","), F.lit("}"))
    rows = p.select("page_id", F.col("requested_url").alias("asked"), record.alias("record"))
    got = webpages.page_fields(rows.select(F.concat_ws(" ", F.col("page_id").cast("string"), "asked").alias("asked"), "record")).select("asked", "title", "markdown", "links", "url")
    number = F.split("asked", " ").getItem(0)
    bare = lambda c: F.regexp_replace(c, r"^\d+ ", "")
    return got.select(number.cast("long").alias("page_id"), webpages.normal_url(bare(F.col("url"))).alias("url"), bare(F.col("title")).alias("title"), "markdown", F.array_join("links", " ").alias("links"))


_STATUSES = ("disallowed", "skipped", "cancelled", "errored", "strange", None)


@register(
    "record_failures",
    "WITH p AS (SELECT DISTINCT page_id, (['disallowed', 'skipped', 'cancelled', 'errored', 'strange', NULL])[CAST(page_id % 6 AS INT) + 1] AS status, CASE WHEN page_id % 4 = 0 THEN 500 + CAST(page_id % 7 AS INT) END AS http FROM web_fetched_pages) "
    "SELECT page_id, coalesce(status, 'errored') AS reason, CASE coalesce(status, 'errored') WHEN 'disallowed' THEN 'crawl record disallowed by robots.txt' WHEN 'skipped' THEN 'crawl record skipped by crawl filters' WHEN 'cancelled' THEN 'crawl record cancelled' "
    "WHEN 'errored' THEN 'crawl record errored' || CASE WHEN http IS NOT NULL THEN ' (http ' || http || ')' ELSE '' END ELSE 'crawl record status=' || status END AS error FROM p",
)
def _(s, d):
    i = F.col("page_id")
    rows = table(s, d, "web_fetched_pages").select("page_id").distinct()
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (i % 6 + 1).cast("int"))
    reason, error = webpages.record_failure(status, F.when(i % 4 == 0, (500 + i % 7).cast("int")))
    return rows.select("page_id", reason.alias("reason"), error.alias("error"))


@register(
    "fetch_modes",
    "WITH p AS (SELECT DISTINCT page_id, length(coalesce(markdown, '')) AS n FROM web_fetched_pages), a AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0 ELSE n END AS g, CASE WHEN page_id % 3 = 0 THEN 0 ELSE n // 2 END AS f FROM p) "
    "SELECT page_id, CASE WHEN g >= 200 THEN 'get' WHEN f >= 1 THEN 'fetch' ELSE 'get' END AS mode, CASE WHEN g >= 200 THEN g WHEN f >= 1 THEN f WHEN g >= 1 THEN g END AS n FROM a",
)
def _(s, d):
    p = table(s, d, "web_fetched_pages").dropDuplicates(["page_id"]).select(F.col("page_id").alias("url"), F.coalesce("markdown", F.lit("")).alias("m"))
    got = p.select("url", F.lit("get").alias("mode"), F.when(F.col("url") % 4 != 0, F.col("m")).alias("markdown"), F.lit("none").alias("error"))
    fetched = p.select("url", F.lit("fetch").alias("mode"), F.when(F.col("url") % 3 != 0, F.expr("substring(m, 1, length(m) div 2)")).alias("markdown"), F.lit("none").alias("error"))
    return webpages.choose_attempt(got.unionByName(fetched)).select(F.col("url").alias("page_id"), "mode", F.length("markdown").cast("long").alias("n"))


@register(
    "first_seen_pages",
    f"SELECT url, page_id FROM (SELECT {_NORMAL_SQL.format(u='final_url')} AS url, min(page_id) AS page_id FROM ({_PAGES_SQL}) GROUP BY ALL) ORDER BY page_id LIMIT 100",
)
def _(s, d):
    rows = table(s, d, "web_fetched_pages").select("page_id", webpages.normal_url(F.col("final_url")).alias("url")).distinct()
    return webpages.first_seen(rows, "url", "page_id", 100).select("url", "page_id")


@register(
    "crawl_site",
    f"WITH RECURSIVE p AS ({_PAGES_SQL}), u AS (SELECT {_NORMAL_SQL.format(u='final_url')} AS url, min(page_id) AS page_id FROM p GROUP BY ALL), root AS (SELECT min(url) AS url FROM u WHERE starts_with(url, '{{site}}')), "
    f"e AS (SELECT DISTINCT {_NORMAL_SQL.format(u='final_url')} AS src, {_NORMAL_SQL.format(u='link')} AS dst FROM (SELECT final_url, unnest(links) AS link FROM p)), "
    "r AS (SELECT url, 0 AS depth FROM root UNION SELECT e.dst, r.depth + 1 FROM r JOIN u ON u.url = r.url JOIN e ON e.src = r.url WHERE r.depth < 2 AND starts_with(e.dst, '{site}')) SELECT r.url, CAST(min(depth) AS INT) AS depth, bool_or(u.url IS NOT NULL) AS fetched FROM r LEFT JOIN u USING (url) GROUP BY r.url".replace("{site}", "https://handbook.mistlewick.example/"),
)
def _(s, d):
    """The crawl of a site over its recorded pages: what is reached, and whether there is a page."""
    site = "https://handbook.mistlewick.example/"
    rows = table(s, d, "web_fetched_pages").dropDuplicates(["page_id"]).where(F.col("final_url").startswith(site))
    named = rows.select(webpages.normal_url(F.col("final_url")).alias("url"), "links", F.coalesce("markdown", F.lit("")).alias("markdown"))
    # a site's recorded pages are the fixture of the page source
    records: dict[str, dict] = {}
    for r in named.collect():
        known = records.setdefault(r["url"], {"url": r["url"], "markdown": "x", "links": {"internal": []}})
        known["links"]["internal"] += r["links"] or []
    if not records:
        return s.createDataFrame([], "url string, depth int, fetched boolean")
    pages, failures = crawl.crawl(s, min(records), webpages.RecordedPages(records), max_pages=100_000, max_depth=3, mode="get", retries=0, scope=site)
    return pages.select("url", "depth", F.lit(True).alias("fetched")).unionByName(failures.select("url", "depth", F.lit(False).alias("fetched")))


# --- the stored index -----------------------------------------------------------------------------

_LAST = "d AS (SELECT DISTINCT id, source_key, source_kind, path FROM kb_documents QUALIFY id = max(id) OVER (PARTITION BY source_key, path))"


_STORED: dict[tuple[str, str], store.Store] = {}


def stored(s: SparkSession, d: str, fresh: bool = False) -> store.Store:
    """A store of the last document of each path, with the chunks as they are; made once a session unless ``fresh``."""
    key = (s.sparkContext.applicationId, d)
    if fresh or key not in _STORED:
        made = _stored(s, d)
        return made if fresh else _STORED.setdefault(key, made)
    return _STORED[key]


def _stored(s: SparkSession, d: str) -> store.Store:
    from lodestrata.session import checkpoint_dir

    at = store.Store(s, f"{checkpoint_dir(s)}/index-{uuid.uuid4().hex}")
    docs = documents(s, d)
    last = docs.groupBy("source_key", "path").agg(F.max("id").alias("id")).select("id")
    kept = docs.join(last, "id", "left_semi").select([c.split()[0] for c in store.DOCUMENTS.split(", ")])
    c = table(s, d, "chunks").dropDuplicates(["id"]).join(kept.select(F.col("id").alias("document_id"), "source_key"), "document_id").withColumn("embedding", EMBEDDER.embed(F.col("content")))
    at.replace_sources(kept.select("source_key"), kept, c, "2026-01-01")
    return at


@register("search_stored", _search_sql(QUERY, LIMIT, []).replace(_D, _LAST))
def _(s, d):
    """Hybrid search over stored chunks, postings and lengths."""
    return stored(s, d).search(QUERY, VECTOR, LIMIT).select("chunk_id", "document_id", "source_key", "path", "section", F.round("score", 9).alias("score"))


@register("search_stored_ext", _search_sql(QUERY, LIMIT, [".md", ".go"]).replace(_D, _LAST))
def _(s, d):
    return stored(s, d).search(QUERY, VECTOR, LIMIT, ["md", ".GO"]).select("chunk_id", "document_id", "source_key", "path", "section", F.round("score", 9).alias("score"))


@register(
    "store_replaced",
    f"WITH {_LAST}, k AS (SELECT min(source_key) AS a, max(source_key) AS b FROM d) SELECT source_key, count(*) AS documents FROM d, k WHERE source_key <> b AND (source_key <> a OR id % 2 = 0) GROUP BY source_key",
)
def _(s, d):
    """One source replaced by half of its documents and one removed, in the store."""
    at = stored(s, d, fresh=True)
    ends = at.documents.agg(F.min("source_key").alias("a"), F.max("source_key").alias("b")).first()
    if ends["a"] is None:
        return at.documents.groupBy("source_key").agg(F.count("*").alias("documents"))
    half = at.documents.where((F.col("source_key") == ends["a"]) & (F.col("id") % 2 == 0))
    at.replace_source(ends["a"], half, at.chunks, "2026-01-02")
    at.delete_source(ends["b"])
    at.vacuum()
    return at.documents.groupBy("source_key").agg(F.count("*").alias("documents"))


@register(
    "doctor",
    "SELECT 'missing' AS at, 'missing' AS status, 'index bootstrap required' AS reason UNION ALL SELECT 'empty', 'degraded', 'embedding fingerprint missing' UNION ALL SELECT 'full', CASE WHEN n > 0 THEN 'degraded' ELSE 'ok' END, CASE WHEN n > 0 THEN 'one or more source rebuilds failed' END FROM "
    "(SELECT count(*) FILTER (WHERE last_rebuild_status = 'failed') AS n FROM source_manifests) UNION ALL SELECT 'healthy', 'ok', NULL",
)
def _(s, d):
    """The health of an index without tables, without a fingerprint, with the given manifests, and without failed ones."""
    from lodestrata.session import checkpoint_dir

    at = store.Store(s, f"{checkpoint_dir(s)}/index-{uuid.uuid4().hex}")
    wanted, got = EMBEDDER.fingerprint(), []
    got.append(("missing", at.doctor(wanted)))
    at.initialise()
    got.append(("empty", at.doctor(wanted)))
    at.set_fingerprint(wanted)
    manifests = table(s, d, "source_manifests").select([c.split()[0] for c in store.MANIFESTS.split(", ")])
    at._change_manifests(lambda known: known.unionByName(manifests))
    got.append(("full", at.doctor(wanted)))
    at._change_manifests(lambda known: known.where("last_rebuild_status <> 'failed'"))
    got.append(("healthy", at.doctor(wanted)))
    return s.createDataFrame([(n, g["status"], g["reason"]) for n, g in got], "at string, status string, reason string")


@register("lookup_path", "SELECT DISTINCT id, source_key FROM kb_documents WHERE path = (SELECT min(path) FROM kb_documents WHERE NOT contains(path, '://'))")
def _(s, d):
    """A path as it is typed, with a leading dot and backslashes."""
    docs = documents(s, d)
    typed = docs.where(~F.contains("path", F.lit("://"))).agg(F.min("path")).first()[0] or ""
    return lookup.by_path(docs, ".\\" + typed.replace("/", "\\")).select("id", "source_key")


@register("eval_metrics", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{str(v).lower() if isinstance(v, bool) else v}')" for k, v in evaluation.BASELINE.items()) + ") v(metric, value)")
def _(s, d):
    """The offline evaluation's counts, against the published ones."""
    metrics, _spent = evaluation.measure(evaluation.chunks(s), len(evaluation.FILES))
    return s.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in metrics.items()], "metric string, value string")


# --- evidence -------------------------------------------------------------------------------------

_RESULTS = f"WITH {_CK}, a AS (SELECT chunk_id, document_id, path, section, round(1.0::DOUBLE / (60 + chunk_id % 7), 9) AS score, chunk_id AS arrival, content FROM ck UNION ALL SELECT chunk_id, document_id, path, section, round(1.0::DOUBLE / (60 + chunk_id % 5), 9), chunk_id + 1000000000, content FROM ck)"


def _results(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(s, d)
    one = c.select("chunk_id", "document_id", "path", "section", F.round(1.0 / (60 + F.col("chunk_id") % 7), 9).alias("score"), F.col("chunk_id").alias("arrival"))
    two = c.select("chunk_id", "document_id", "path", "section", F.round(1.0 / (60 + F.col("chunk_id") % 5), 9).alias("score"), (F.col("chunk_id") + 1_000_000_000).alias("arrival"))
    return one.unionByName(two), c


@register("evidence_merge", f"{_RESULTS} SELECT chunk_id, document_id, score FROM a QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, arrival) = 1")
def _(s, d):
    return evidence.merge(*_results(s, d)).select("chunk_id", "document_id", "score")


@register("evidence_rank", f"{_RESULTS} SELECT chunk_id, document_id, score, CAST(row_number() OVER (ORDER BY score DESC, document_id, chunk_id) AS INT) AS evidence_id FROM (SELECT chunk_id, document_id, max(score) AS score FROM a GROUP BY ALL) QUALIFY evidence_id <= 25")
def _(s, d):
    return evidence.rank(evidence.merge(*_results(s, d)), 25).select("chunk_id", "document_id", "score", "evidence_id")


@register(
    "citation_validate",
    f"WITH {_CK}, e AS (SELECT chunk_id AS evidence_id, content AS excerpt FROM ck WHERE chunk_id % 3 <> 0), q AS (SELECT chunk_id AS evidence_id, CASE WHEN chunk_id % 2 = 0 THEN substr(content, 1, 12) ELSE 'not in there at all' END AS quote FROM ck) "
    "SELECT q.evidence_id, CASE WHEN contains(excerpt, quote) THEN quote END AS quote, excerpt IS NOT NULL AS valid FROM q LEFT JOIN e USING (evidence_id)",
)
def _(s, d):
    c = chunks(s, d).select(F.col("chunk_id").alias("evidence_id"), "content")
    known = c.where("evidence_id % 3 <> 0").select("evidence_id", F.col("content").alias("excerpt"))
    given = c.select("evidence_id", F.when(F.col("evidence_id") % 2 == 0, F.substring("content", 1, 12)).otherwise("not in there at all").alias("quote"), F.lit(0).alias("position"))
    return evidence.validate(given, known, QUERY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
