"""Near-duplicate records: MinHash candidates, verified by banded alignment and by exact counts.

Method: a record's distinct k-mers (runs of words) are hashed; each of ``rows`` hash functions
samples the ``order`` smallest, and the set of them is a sketch. Two equal sketches make a
candidate. No k-mer is left out for being common and no bucket is cut: in a large family of near
copies every pair is a candidate, and phrases that half the collection uses make few candidates,
as all ``order`` minima must be shared. At a similarity of exactly 0.6 a pair is missed with a
probability of about 0.00002, in whatever order its sections stand. A banded alignment of the
words shows how many k-mers both share in order; where that already reaches the threshold the
pair is accepted, else (moved sections) the shared distinct k-mers are counted.

Exact copies (equal word sequences) form a class first; the sketches of each class go on once, so
that a class that holds a third of all rows makes no pairs. Links run between representatives.
Buckets of equal sketches that grow large are cut into blocks, each pair of which is a cell of its
own, so that no sketch decides how much one task holds.

Defined results for odd input: null, empty and short texts (fewer than ``least`` words) have no
links; rows delivered twice (same id) count once; ties go to the smaller id; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_pairs, cut, mix64, shingle_hashes, word_hashes, words_of


class MinHash:
    """``rows`` sketches of ``order`` minima each over the distinct k-mers, one 64-bit key a sketch."""

    def __init__(self, rows: int, order: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.order = order
        self.mul = (rng.integers(1, 2**31, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
        self.add = rng.integers(0, 2**32, size=rows, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = mix64(np.arange(1, rows + 1, dtype=np.uint64))

    def keys(self, kmers: np.ndarray) -> np.ndarray:
        x = np.unique((kmers >> np.uint64(32)).astype(np.uint32) ^ kmers.astype(np.uint32))
        if len(x) < self.order:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            # every step is a bijection of 32 bits, so that equal minima are equal k-mers
            m = x[None, :] * self.mul + self.add
            m ^= m >> np.uint32(15)
            m *= np.uint32(0x2C1B3C6D)
            if len(x) > self.order:
                m.partition(self.order - 1, axis=1)
            least = np.sort(m[:, : self.order], axis=1).astype(np.uint64)
            key = self.salt.copy()
            for j in range(self.order):
                key = mix64(key * np.uint64(31) + least[:, j])
        return key


def banded_lcs(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence of two sequences within ``band`` places of the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n:
        return 0
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << n) - 1
    v = full
    width = (1 << (2 * band + 1)) - 1
    for j, y in enumerate(b):
        mask = at.get(y)
        if mask is None:
            continue
        centre = j * n // m - band
        mask &= width << centre if centre >= 0 else width >> -centre
        if mask:
            u = v & mask
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def similarity(a: str, b: str, k: int, least: int, band: int, threshold: float) -> tuple[float, float, bool]:
    """(share of aligned words, share of common distinct k-mers, whether alignment alone sufficed)."""
    wa, wb = words_of(a), words_of(b)
    if len(wa) < least or len(wb) < least:
        return 0.0, 0.0, False
    ha, hb = word_hashes(wa), word_hashes(wb)
    ka, kb = shingle_hashes(ha, k).tolist(), shingle_hashes(hb, k).tolist()
    sa, sb = set(ka), set(kb)
    aligned = banded_lcs(ka, kb, band)
    distinct_aligned = max(0, aligned - (len(ka) - len(sa)) - (len(kb) - len(sb)))
    common = len(sa & sb)
    either = len(sa) + len(sb) - common
    edit = aligned / max(len(ka), len(kb), 1)
    sufficed = distinct_aligned / max(1, len(sa) + len(sb) - distinct_aligned) >= threshold
    return edit, common / max(1, either), sufficed


def near_copies(
    df: DataFrame, id_col: str, text_col: str, *, k: int = 5, threshold: float = 0.8, least: int = 30, rows: int = 56, order: int = 3, band: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, class_id) of the classes of equal word sequences, and links
    (class_a, class_b, edit_similarity, similarity) between classes at or above the threshold."""
    sketcher = MinHash(rows, order)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()  # classes whose sketches this task has sent; only saves rows
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["t"]):
                words = words_of(t) if isinstance(t, str) else []
                if len(words) >= least:
                    same = xxhash.xxh3_128_digest("\x00".join(words).encode("utf-8", "surrogatepass"))
                    short = int.from_bytes(same[:8], "little", signed=True)
                    keys = None
                    if short not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(short)
                        keys = sketcher.keys(shingle_hashes(word_hashes(words), k)).view(np.int64)
                    out.append((i, same, short, keys))
            yield pd.DataFrame(out, columns=["id", "same", "short", "keys"])

    sketched = cut(texts.mapInPandas(sketch, "id long, same binary, short long, keys array<long>"))
    classes = cut(sketched.groupBy("same").agg(F.min("id").alias("class_id"), F.first("short").alias("short")))
    members = sketched.select("id", "same").distinct().join(classes.select("same", "class_id"), "same").select("id", "class_id")
    # a class goes by 64 bits of its digest here; two that share them are both verified below
    keyed = sketched.where("keys is not null").select(F.explode("keys").alias("key"), F.col("short").alias("id")).repartition("key").distinct()
    # two equal sketches at least: one alone is mostly chance
    met = bucket_pairs(keyed).groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(F.count("*").alias("n")).where("n > 1")
    by = classes.select("short", "class_id")
    named = met.join(by.toDF("x", "c"), "x").join(by.toDF("y", "d"), "y")
    pairs = cut(named.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(x, y, *similarity(s, t, k, least, band, threshold)) for x, y, s, t in zip(batch["a"], batch["b"], batch["s"], batch["t"])]
            yield pd.DataFrame(
                [(x, y, e, c) for x, y, e, c, sufficed in got if sufficed or c >= threshold],
                columns=["class_a", "class_b", "edit_similarity", "similarity"],
            )

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    contents = cut(texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    joined = pairs.join(contents.select(F.col("id").alias("a"), F.col("t").alias("s")), "a").join(contents.withColumnRenamed("id", "b"), "b")
    links = joined.select("a", "b", "s", "t").mapInPandas(verify, "class_a long, class_b long, edit_similarity double, similarity double")
    return members, links


def classes_with_links(df: DataFrame, id_col: str = "id", text_col: str = "content", **settings) -> DataFrame:
    """One row per record: its class and the number of classes it is linked to."""
    members, links = near_copies(df, id_col, text_col, **settings)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def class_links(df: DataFrame, id_col: str = "id", text_col: str = "content", **settings) -> DataFrame:
    """(class_a, class_b, similarity): the links between classes of different texts, each once."""
    _, links = near_copies(df, id_col, text_col, **settings)
    return links.select("class_a", "class_b", F.round("similarity", 6).alias("similarity"))


def found(documents: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) of records at 0.6 or more on runs of three words, equal contents included."""
    members, links = near_copies(documents, "id", "content", k=3, threshold=0.6, least=30)
    members = cut(members)
    own = members.select("class_id", F.col("class_id").alias("other"))
    both = links.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(own.distinct())
    left = members.select(F.col("id").alias("x"), "class_id")
    right = members.select(F.col("id").alias("y"), F.col("class_id").alias("other"))
    pairs = both.join(left, "class_id").join(right, "other").where("x <> y").where("class_id <> other or x < y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
