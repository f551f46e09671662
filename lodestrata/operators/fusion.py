"""Hybrid search: reciprocal rank fusion, query-aware boosts and the candidate ladder, as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.session import cut

from . import retrieve as R

RRF = 60


def ladder(limit: int) -> list[int]:
    """Candidate limits to try, from the first to the last."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    steps, most = [max(3 * limit, limit + 8)], max(3 * limit, limit + 8, 16 * limit, limit + 64, 64)
    while steps[-1] < most:
        steps.append(min(2 * steps[-1], most))
    return steps


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / (F.lit(RRF) + rank), F.lit(0.0))


Index = tuple[DataFrame, DataFrame]


def ranks(chunks: DataFrame, query: str, vector: list[float], most: int, suffixes: list[str], index: Index | None = None) -> DataFrame:
    """(chunk_id, v, f, l, m): each retriever's rank up to ``most``; l only where full text found nothing.

    index: stored postings and lengths; without them the contents are counted.
    """
    if index:
        full = R.full_text_indexed(*index, query, most, suffixes)
        by = {"vector": R.vector_knn(chunks, vector, most, suffixes), "place": R.path_section_match(chunks, query, most, suffixes)}
    else:
        by = R.ranks_of(cut(R.measures(chunks, query, vector, suffixes)), query, most)  # a few numbers a chunk
        full = by["text"]
    full = cut(full.select("chunk_id", F.col("rank").alias("f")))  # read twice, at most ``most`` rows
    # whether the fallback is needed is known by now: contents are only searched where it is
    needed = full.isEmpty()
    fallback = by.get("content", R.substring_match(chunks, query, most, suffixes)) if needed else full.where("false").withColumn("rank", F.lit(0))
    parts = [by["vector"].select("chunk_id", F.col("rank").alias("v")), full, fallback.select("chunk_id", F.col("rank").alias("l")), by["place"].select("chunk_id", F.col("rank").alias("m"))]
    return reduce(lambda a, b: a.join(b, "chunk_id", "full"), parts)


def at_step(candidates: DataFrame, limit: int) -> DataFrame:
    """The candidates at the first step of the ladder that has ``limit`` of them, ranks beyond it blank."""
    steps, candidates = ladder(limit), cut(candidates)  # at most four times the ladder's last step
    least = F.least(*[F.coalesce(c, F.lit(2**31 - 1)) for c in ("v", "f", "l", "m")])
    counts = candidates.agg(*[F.count_if(least <= s).alias(f"n{s}") for s in steps])
    chosen = reduce(lambda rest, s: F.when(F.col(f"n{s}") >= limit, s).otherwise(rest), reversed(steps[:-1]), F.lit(steps[-1]))
    stepped = candidates.crossJoin(F.broadcast(counts.select(chosen.alias("step"))))  # one row
    blank = [F.when(F.col(c) <= F.col("step"), F.col(c)).alias(c) for c in ("v", "f", "l", "m")]
    return stepped.where(least <= F.col("step")).select("chunk_id", *blank, "step")


def boost(query: str) -> Column:
    """What a row's path, section and content add for this query."""
    packed, terms = T.compact_literal(query), T.terms_of(query)
    place = F.concat_ws(" ", "path", F.coalesce("section", F.lit("")))
    direct = F.when(F.contains(T.compact(place), F.lit(packed)), 0.03).when(F.contains(T.compact(F.col("content")), F.lit(packed)), 0.012).otherwise(0.0) if len(packed) >= 2 else F.lit(0.0)
    return direct + F.lit(0.02) * T.coverage(place, terms) + F.lit(0.008) * T.coverage(F.col("content"), terms)


def search(chunks: DataFrame, query: str, vector: list[float], limit: int = 8, suffixes: list[str] | None = None, index: Index | None = None) -> DataFrame:
    """(chunk_id, document_id, source_key, source_kind, path, section, snippet, score), best first."""
    wanted = T.normalize_suffixes(suffixes or [])
    found = at_step(ranks(chunks, query, vector, ladder(limit)[-1], wanted, index), limit)
    if T.needs_lexical_match(query):
        # an identifier that no lexical retriever knows has no hits, whatever is near by vector
        seen = found.agg(F.count_if(F.coalesce("f", "l", "m").isNotNull()).alias("lexical"))
        found = found.crossJoin(F.broadcast(seen)).where("lexical > 0").drop("lexical")  # one row
    few = F.broadcast(found)  # at most four times the ladder's last step
    # the semi join reaches below what the caller does to the chunks
    rows = chunks.join(few.select("chunk_id"), "chunk_id", "left_semi").join(few, "chunk_id")
    score = reciprocal(F.col("v")) + reciprocal(F.col("f")) + reciprocal(F.col("l")) + boost(query)
    out = rows.select("chunk_id", "document_id", "source_key", "source_kind", "path", "section", T.snippet(F.col("content"), query).alias("snippet"), F.round(score, 12).alias("score"))
    return out.orderBy(F.col("score").desc(), "document_id", "chunk_id").limit(limit)


def diagnostics(chunks: DataFrame, query: str, vector: list[float], limit: int = 8, suffixes: list[str] | None = None, index: Index | None = None) -> DataFrame:
    """One row: candidates of each retriever, which were used, and whether ranks were fused."""
    found = at_step(ranks(chunks, query, vector, ladder(limit)[-1], T.normalize_suffixes(suffixes or []), index), limit)
    counts = found.agg(*[F.count(c).alias(n) for c, n in (("v", "vector_candidates"), ("f", "fts_candidates"), ("l", "lexical_candidates"), ("m", "metadata_candidates"))])
    used = F.concat_ws(",", *[F.when(F.col(f"{n}_candidates") > 0, n) for n in ("vector", "fts", "lexical", "metadata")])
    fused = (F.col("vector_candidates") > 0) | (F.col("fts_candidates") > 0) | (F.col("lexical_candidates") > 0)
    return counts.withColumns({"retrievers_used": used, "rrf_used": fused})
