"""Shared pieces of the training-text operators."""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut, table

__all__ = ["CODE_SUFFIXES", "WORDS", "bucket_pairs", "cut", "mix64", "shingle_hashes", "table", "word_hashes", "words_of"]

#: Longest runs of letters and digits; an underscore separates.
WORDS = re.compile(r"[^\W_]+")

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


class _WordCache(dict):
    """word -> 64-bit hash; emptied when large, as it only saves time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_CACHE = _WordCache()


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_CACHE.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` consecutive word hashes, in text order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, k):
            h = (h * _A) ^ (h >> np.uint64(29))
            h += words[j : j + n]
    return mix64(h)


#: Language labels whose files are program code (not prose, not settings).
CODE_SUFFIXES = (
    "c", "cc", "cjs", "cpp", "cs", "css", "cts", "cxx", "go", "h", "hpp", "java", "js", "jsx",
    "kt", "less", "lua", "mjs", "mts", "php", "pl", "py", "rb", "rs", "scala", "scss", "sh", "bash", "swift", "ts", "tsx",
)


def bucket_pairs(members: DataFrame, block: int = 512, only: str | None = None) -> DataFrame:
    """(x, y) of all pairs within each bucket, each once; members: (key, id, ...), distinct, best partitioned by key.

    only: a boolean column of the members, true for at least one of a pair (for x); pairs of others
    aren't made. A bucket beyond ``block`` members is cut into blocks by a hash of the id, and each
    pair of blocks meets in a cell of its own: at most ``block`` squared pairs at once, and none lost.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("bucket_n")).where("bucket_n > 1")
    sized = members.join(sizes, "key")
    row = F.struct(*[c for c in members.columns if c != "key"])
    first = F.col(only) if only else F.lit(True)
    few = sized.where(F.col("bucket_n") <= block)
    small = few.where(first).select("key", row.alias("x")).join(few.select("key", row.alias("y")), "key")
    blocks = F.ceil(F.col("bucket_n") / block)
    many = sized.where(F.col("bucket_n") > block).select("*", F.pmod(F.xxhash64("id"), blocks).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("o"))
    cells = [F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")]
    left = many.where(first).select("key", row.alias("x"), F.col("b").alias("bx"), *cells)
    right = many.select("key", row.alias("y"), F.col("b").alias("by"), *cells)
    large = left.join(right, ["key", "lo", "hi"]).where((F.least("bx", "by") == F.col("lo")) & (F.greatest("bx", "by") == F.col("hi")))
    once = F.col("x.id") < F.col("y.id")
    if only:
        once = (F.col("x.id") != F.col("y.id")) & (once | ~F.col(f"y.{only}"))
    return small.select("x", "y").unionByName(large.select("x", "y")).where(once)


@functools.cache
def vocabulary(path: str) -> frozenset[str]:
    """Whole words (three letters or more) of a public tokenizer file; an unreadable one is an error."""
    import json

    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    return frozenset(w for e in entries if e.endswith("</w>") and len(w := e[:-4]) > 2 and w.isalpha())
