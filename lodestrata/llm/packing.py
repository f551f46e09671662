"""Filling containers of fixed capacity with whole items.

Method: conflict-constrained best-fit. Items come by falling size; bins are kept in order of their
residual space and carry bitmaps of the sources and duplicate clusters they hold. The successor
search starts at the tightest bin that has room and goes on until a compatible one is found: copies
of one text never share a container; among equally tight bins one without the item's source wins.
``apart`` makes the source a constraint too. It isn't by default, as there are fewer sources than items
in a container: at 0.1 the containers of 8,192 tokens would be 46 % full instead of 99.8 %, those of
2,048 91 % instead of 99.96 % (measured).

Items are spread over groups by a hash, so that neither a large source nor a large cluster decides
how much one task holds; containers that aren't nearly full are opened again and packed once more
across groups.

Defined results for odd input: items of no or unknown size (null, 0, negative) are left out; an
item beyond the capacity fills containers of its own and only its rest is packed with others; ties
go to the smaller id; equal items are items in their own right; empty input gives no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

GROUP = 4096


def best_fit(items: list[tuple[int, int, int, int, object]], capacity: int, apart: bool = False) -> list[list[int]]:
    """Indices of the items in each bin; items: (size, cluster, source, ...), size within capacity.

    apart: a bin that holds an item's source isn't compatible either.
    """
    shared = {c for c, n in Counter(x[1] for x in items).items() if n > 1}
    cluster_bit: dict[int, int] = {}
    source_bit: dict[object, int] = {}
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1], items[i][3]))
    free: list[tuple[int, int]] = []  # (residual, bin), in order
    bins: list[list[int]] = []
    clusters: list[int] = []
    sources: list[int] = []
    for i in order:
        size, cluster, source = items[i][:3]
        cb = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster in shared else 0
        sb = 1 << source_bit.setdefault(source, len(source_bit))
        at, chosen = bisect_left(free, (size, -1)), -1
        while at < len(free):
            residual, b = free[at]
            if chosen >= 0 and residual != free[chosen][0]:
                break
            if not clusters[b] & cb:
                if not sources[b] & sb:
                    chosen = at
                    break
                if chosen < 0 and not apart:
                    chosen = at
            at += 1
        if chosen < 0:
            b, residual = len(bins), capacity
            bins.append([])
            clusters.append(0)
            sources.append(0)
        else:
            residual, b = free.pop(chosen)
        bins[b].append(i)
        clusters[b] |= cb
        sources[b] |= sb
        if residual > size:
            insort(free, (residual - size, b))
    return bins


def pack(items: DataFrame, capacity: int, group: int = GROUP, nearly_full: float = 0.98, salt: int = 0, apart: bool = False) -> DataFrame:
    """(container, doc_id, piece_no, tokens) for items (doc_id, source, tokens, copy_key)."""
    sized = items.where("doc_id is not null and tokens > 0")
    full = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(F.lit(0)).cast("long")
    split = sized.withColumn("full", full)
    whole = split.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
    whole = whole.select(F.concat_ws("-", F.lit("w"), "doc_id", "piece_no").alias("container"), "doc_id", "piece_no", F.lit(capacity).cast("long").alias("tokens"))
    rest = split.select("doc_id", "source", "copy_key", F.col("full").alias("piece_no"), (F.col("tokens") - F.col("full") * capacity).alias("tokens")).where("tokens > 0")
    schema = "container string, doc_id long, source string, copy_key long, piece_no long, tokens long, used long"

    def fill(tag: str):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            rows = list(zip(pdf["tokens"], pdf["copy_key"], pdf["source"], pdf["doc_id"], pdf["piece_no"]))
            out = []
            for n, b in enumerate(best_fit(rows, capacity, apart)):
                used = sum(rows[i][0] for i in b)
                out += [(f"{tag}{key[0]}-{n}", rows[i][3], rows[i][2], rows[i][1], rows[i][4], rows[i][0], used) for i in b]
            return pd.DataFrame(out, columns=["container", "doc_id", "source", "copy_key", "piece_no", "tokens", "used"])

        return run

    def grouped(df: DataFrame, n: int, seed: int) -> DataFrame:
        return df.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(seed)), F.lit(max(1, -(-n // group)))))

    rest = cut(rest)
    first = cut(grouped(rest, rest.count(), salt).groupBy("g").applyInPandas(fill("a"), schema))
    done = first.where(F.col("used") >= nearly_full * capacity)
    again = first.where(F.col("used") < nearly_full * capacity).drop("container", "used")
    second = grouped(again, again.count(), salt + 1).groupBy("g").applyInPandas(fill("b"), schema)
    out = ["container", "doc_id", "piece_no", "tokens"]
    return whole.select(out).unionByName(done.select(out)).unionByName(second.select(out))


def packed(items: DataFrame, capacities: dict[str, int], **settings) -> DataFrame:
    """Containers of each named capacity: (capacity_name, container, doc_id, piece_no, tokens)."""
    items = cut(items)
    parts = [pack(items, c, **settings).select(F.lit(name).alias("capacity_name"), "container", "doc_id", "piece_no", "tokens") for name, c in sorted(capacities.items())]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def fill_report(containers: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """One row a capacity: containers, items and the share of space used."""
    cap = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])
    by = containers.groupBy("capacity_name").agg(F.countDistinct("container").alias("containers"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return by.withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * cap[F.col("capacity_name")]), 6))


__all__ = ["best_fit", "fill_report", "pack", "packed"]
