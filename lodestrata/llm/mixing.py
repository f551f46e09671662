"""Mixing sources to target weights.

Method: capped water-filling. A source gives at most ``max_repeats`` times its tokens; sources
whose target exceeds that are clamped there, and what they can't give is spread over the others in
proportion to their targets until all are feasible. Each source's records are then drawn as whole
repetitions of all of them plus a fraction: the records with the smallest seeded hashes, up to the
fraction of the source's tokens.

The fraction's cut is found from a histogram of hash cells (``CELLS`` a source at most), whose running
sums are made in the plan, so no source's records are gathered or sorted in one place and nothing but
the totals of the listed sources reaches the driver; the error is below one cell of a source.

Defined results for odd input: source names are compared after trimming, in lower case; records of
null or unlisted sources aren't drawn; listed sources without records get share 0 and their target
goes to the others; targets needn't sum to 1; negative or null targets and repeats count as 0; a
source listed twice has its targets added; with no feasible source nothing is drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CELLS = 4096


def water_fill(targets: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens to draw of each source: at most its cap, else in proportion to its target."""
    weight = {s: max(0.0, w or 0.0) for s, w in targets.items()}
    out = dict.fromkeys(weight, 0.0)
    open_ = {s for s, w in weight.items() if w > 0 and caps.get(s, 0) > 0}
    left = min(float(total), sum(caps[s] for s in open_))
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        clamped = {s for s in open_ if weight[s] * unit >= caps[s]}
        if not clamped:
            for s in open_:
                out[s] = weight[s] * unit
            break
        for s in clamped:
            out[s] = float(caps[s])
            left -= caps[s]
        open_ -= clamped
    return out


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    """The table of targets, which is fixed and small: source -> (share, repeats)."""
    out: dict[str, tuple[float, int]] = {}
    for r in mix.select(F.lower(F.trim("source")).alias("s"), "target_share", "max_repeats").collect():
        if r["s"] is not None:
            share, repeats = out.get(r["s"], (0.0, 0))
            out[r["s"]] = (share + max(0.0, r["target_share"] or 0.0), max(repeats, r["max_repeats"] or 0))
    return out


def plan(records: DataFrame, mix: DataFrame, total: int | None = None) -> dict[str, tuple[float, int, int, float]]:
    """source -> (target share, repeats allowed, tokens there, tokens to draw)."""
    targets = _targets(mix)
    have = {r["source"]: r["n"] for r in records.where(F.col("source").isin(*targets)).groupBy("source").agg(F.sum("tokens").alias("n")).collect()} if targets else {}
    caps = {s: float((have.get(s) or 0) * n) for s, (_, n) in targets.items()}
    wanted = sum(have.values()) if total is None else total
    drawn = water_fill({s: w for s, (w, _) in targets.items()}, caps, wanted)
    return {s: (w, n, have.get(s) or 0, drawn[s]) for s, (w, n) in targets.items()}


def draw(records: DataFrame, mix: DataFrame, total: int | None = None, seed: int = 23) -> DataFrame:
    """(doc_id, source, tokens, copies) of the records drawn; records: (doc_id, source, tokens)."""
    planned = plan(records, mix, total)
    active = {s: p for s, p in planned.items() if p[2] and p[3]}
    spark = records.sparkSession
    base = spark.createDataFrame([(s, int(p[3] // p[2]), float(p[3] - p[3] // p[2] * p[2])) for s, p in active.items()], "source string, whole long, rest double")
    listed = records.where("tokens > 0").join(F.broadcast(base), "source")  # as many rows as the table of targets
    cell = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(CELLS)).alias("cell")
    celled = listed.select("doc_id", "source", "tokens", "whole", "rest", cell)
    histogram = celled.groupBy("source", "cell").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("cell"))  # at most CELLS rows
    # a cell is drawn where its middle lies within what is wanted beyond whole repetitions
    ends = histogram.withColumn("within", upto - F.col("n") / 2 <= F.col("rest")).groupBy("source").agg(F.coalesce(F.max(F.when(F.col("within"), F.col("cell") + 1)), F.lit(0)).alias("cut"))
    chosen = celled.join(F.broadcast(ends), "source")  # as many rows as the table of targets
    copies = F.col("whole") + F.when(F.col("cell") < F.col("cut"), 1).otherwise(0)
    return chosen.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def shares(drawn: DataFrame, records: DataFrame, mix: DataFrame) -> DataFrame:
    """One row a listed source: target, tokens there and drawn, repetitions, and the share reached."""
    targets = mix.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    have = records.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    whole = drawn.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all"))
    rows = targets.join(have, "source", "left").join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
    return rows.select(
        "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce("drawn_tokens", F.lit(0)) / F.greatest(F.coalesce("all", F.lit(1)), F.lit(1)), 6).alias("actual_share"),
    )


def mixed(records: DataFrame, mix: DataFrame, total: int | None = None, seed: int = 23) -> DataFrame:
    """The drawn records, each with its source's share reached."""
    records = cut(records.select("doc_id", "source", "tokens"))
    drawn = draw(records, mix, total, seed)
    reached = shares(drawn, records, mix).select("source", "target_share", "actual_share")
    return drawn.join(F.broadcast(reached), "source").select("doc_id", "source", "tokens", "copies", "target_share", "actual_share")  # as many rows as targets
