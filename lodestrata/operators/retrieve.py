"""Retrievers. Each takes chunks (chunk_id, document_id, path, section, content[, embedding]) and
returns (chunk_id, rank): 1-based, in a total order, cut to ``limit`` before ranks are numbered.

The inverted index is a table of postings (term, chunk_id, tf) to be written bucketed by term;
``full_text`` without one counts only the query's terms, in a single pass over the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.session import cut

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _ranked(scored: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Top ``limit`` first (a distributed top-k), then numbered: the window sees ``limit`` rows."""
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def distance(c: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(c, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def vector_knn(chunks: DataFrame, query: list[float], limit: int, suffixes: list[str] | None = None, column: str = "embedding") -> DataFrame:
    kept = chunks.where(T.has_suffix(F.col("path"), suffixes)) if suffixes else chunks
    scored = kept.where(F.size(column) == len(query)).select("chunk_id", F.round(distance(F.col(column), query), 12).alias("distance"))
    return _ranked(scored, [F.col("distance").asc(), F.col("chunk_id").asc()], limit)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 20_000, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, distance, rank): the ``k`` nearest of all vectors to each query; both are (vec_id, embedding).

    Queries go in blocks of at most ``block``, each sent to all tasks and compared in one pass over
    the vectors; so what is sent is bounded however many queries there are. A pass keeps k rows a
    query and task. Exact; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, distance double"
    passes = max(1, -(-queries.count() // block))
    found = spark.createDataFrame([], schema)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, passes))) if passes > 1 else F.lit(0)
    for n in range(passes):
        # about ``block`` rows
        rows = queries.where(part == n).select("vec_id", "embedding").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["embedding"] for r in rows], dtype=np.float64)))

        def compare(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for b in batches:
                if not len(b):
                    continue
                e, own = np.array(b["embedding"].tolist(), dtype=np.float64), b["vec_id"].to_numpy()
                for lo in range(0, len(ids), 256):
                    dist = np.round(np.sqrt(((q[lo : lo + 256, None, :] - e[None, :, :]) ** 2).sum(axis=2)), digits)
                    top = [np.lexsort((own, row))[:k] for row in dist]
                    yield pd.DataFrame({"query_id": np.repeat(ids[lo : lo + 256], [len(t) for t in top]), "vec_id": np.concatenate([own[t] for t in top]), "distance": np.concatenate([row[t] for row, t in zip(dist, top)])})

        ranked = vectors.select("vec_id", "embedding").mapInPandas(compare, schema).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
        found = ranked if passes == 1 else found.unionByName(cut(ranked), allowMissingColumns=True)
    return found if "rank" in found.columns else found.withColumn("rank", F.lit(None).cast("int"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) of every chunk."""
    return chunks.select("chunk_id", F.explode(T.tokens(F.col("content"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(T.tokens(F.col("content"))).cast("long").alias("dl"), "path")


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(IDF_FLOOR), F.log((n - df + 0.5) / (df + 0.5)))


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def _counts(terms: list[str]) -> list[Column]:
    words = T.tokens(F.col("content"))
    return [F.size(words).alias("dl"), *[_count(words, t).alias(f"tf{i}") for i, t in enumerate(terms)]]


def _bm25(counted: DataFrame, hits: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, score) of ``hits``, with the statistics of all rows of ``counted``."""
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = hits.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}").cast("double")
        score = score + _idf(F.col("n"), F.col(f"df{i}")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.select("chunk_id", F.round(score, 9).alias("score"))


def full_text(chunks: DataFrame, query: str, limit: int, suffixes: list[str] | None = None) -> DataFrame:
    """BM25 over contents; the corpus statistics aren't restricted by the suffix filter."""
    terms = T.terms_of(query)[: T.QUERY_TOKENS]
    if not terms:
        return chunks.where("false").select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    counted = chunks.select("chunk_id", "path", *_counts(terms))
    hits = counted.where(T.has_suffix(F.col("path"), suffixes)) if suffixes else counted
    return _ranked(_bm25(counted, hits, terms), [F.col("score").desc(), F.col("chunk_id").asc()], limit)


def measures(chunks: DataFrame, query: str, vector: list[float], suffixes: list[str], column: str = "embedding") -> DataFrame:
    """What all retrievers need of each chunk, in one pass over the contents: (chunk_id, kept, distance, dl, tf0.., content_quality, place_quality)."""
    terms = T.terms_of(query)[: T.QUERY_TOKENS]
    near = F.when(F.size(column) == len(vector), F.round(distance(F.col(column), vector), 12))
    kept = T.has_suffix(F.col("path"), suffixes) if suffixes else F.lit(True)
    return chunks.select("chunk_id", kept.alias("kept"), near.alias("distance"), *_counts(terms), _content_quality(query).alias("content_quality"), _place_quality(query).alias("place_quality"))


def ranks_of(measured: DataFrame, query: str, limit: int) -> dict[str, DataFrame]:
    """The four retrievers' (chunk_id, rank) from ``measures``."""
    terms = T.terms_of(query)[: T.QUERY_TOKENS]
    kept, order = measured.where("kept"), F.col("chunk_id").asc()
    none = measured.where("false").select("chunk_id", F.lit(0).alias("rank"))
    return {
        "vector": _ranked(kept.where("distance is not null").select("chunk_id", "distance"), [F.col("distance").asc(), order], limit),
        "text": _ranked(_bm25(measured, kept, terms), [F.col("score").desc(), order], limit) if terms else none,
        "content": _ranked(kept.where("content_quality > 0").select("chunk_id", "content_quality"), [F.col("content_quality").desc(), order], limit),
        "place": _ranked(kept.where("place_quality > 0").select("chunk_id", "place_quality"), [F.col("place_quality").desc(), order], limit),
    }


def full_text_indexed(index: DataFrame, sizes: DataFrame, query: str, limit: int, suffixes: list[str] | None = None) -> DataFrame:
    """The same ranking from stored postings and lengths (with paths, for suffixes): reads only the query's terms."""
    terms = T.terms_of(query)[: T.QUERY_TOKENS]
    hits = (index.where(F.col("term").isin(*terms)) if terms else index.where("false")).select("term", "chunk_id", "tf")
    stats = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    kept = sizes.where(T.has_suffix(F.col("path"), suffixes)) if suffixes else sizes
    joined = hits.join(F.broadcast(df), "term").join(kept.select("chunk_id", "dl"), "chunk_id").crossJoin(F.broadcast(stats))  # at most eight rows, and one
    tf = F.col("tf").cast("double")
    part = _idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    order = F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(i))]) if terms else F.lit(None)
    parts = joined.select("chunk_id", F.struct(order[F.col("term")].alias("i"), part.alias("p")).alias("s"))
    summed = parts.groupBy("chunk_id").agg(F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda a, x: a + x["p"]).alias("score"))
    return _ranked(summed.select("chunk_id", F.round("score", 9).alias("score")), [F.col("score").desc(), F.col("chunk_id").asc()], limit)


def _content_quality(query: str) -> Column:
    """The number of terms that a content holds, more for the whole phrase; 0 without any."""
    terms, phrase = T.terms_of(query)[: T.QUERY_TOKENS], query.strip().lower()
    low = F.lower("content")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    bonus = F.when(F.contains(low, F.lit(phrase)), 100).otherwise(0) if len(phrase) >= 2 else F.lit(0)
    return F.when(hits > 0, hits + bonus).otherwise(0)


def _place_quality(query: str) -> Column:
    """The number of terms that a path and a section hold, more for the whole phrase; 0 without any."""
    terms, phrase = T.terms_of(query), query.strip().lower()
    path, section = F.lower("path"), F.lower(F.coalesce("section", F.lit("")))
    hits = sum((F.contains(path, F.lit(t)).cast("int") + F.contains(section, F.lit(t)).cast("int") for t in terms), F.lit(0))
    bonus = F.when(F.contains(path, F.lit(phrase)), 100).otherwise(0) + F.when(F.contains(section, F.lit(phrase)), 80).otherwise(0) if len(phrase) >= 2 else F.lit(0)
    return F.when(hits > 0, hits + bonus).otherwise(0)


def _matched(chunks: DataFrame, quality: Column, limit: int, suffixes: list[str] | None) -> DataFrame:
    kept = chunks.where(T.has_suffix(F.col("path"), suffixes)) if suffixes else chunks
    scored = kept.select("chunk_id", quality.alias("quality")).where("quality > 0")
    return _ranked(scored, [F.col("quality").desc(), F.col("chunk_id").asc()], limit)


def substring_match(chunks: DataFrame, query: str, limit: int, suffixes: list[str] | None = None) -> DataFrame:
    """Fallback: contents that contain any term, by the number of terms, whole phrases first."""
    return _matched(chunks, _content_quality(query), limit, suffixes)


def path_section_match(chunks: DataFrame, query: str, limit: int, suffixes: list[str] | None = None) -> DataFrame:
    """Paths and sections that contain any term; whole phrases add to the quality only."""
    return _matched(chunks, _place_quality(query), limit, suffixes)
