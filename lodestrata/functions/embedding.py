"""Embedding providers that run inside the plan: keyword indicators and hashed words."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


@dataclass(frozen=True)
class Fingerprint:
    """What an index was embedded with; two are equal if all six fields are."""

    provider: str
    model: str
    dimensions: int
    task_type: str
    chunking_version: str
    chunker: str

    def json(self) -> dict:
        return asdict(self)


class EmbeddingProvider(Protocol):
    def embed(self, c: Column) -> Column: ...

    def embed_query(self, query: str) -> list[float]: ...

    def fingerprint(self) -> Fingerprint: ...


def query_task(task_type: str) -> str:
    """The task that a query is embedded for: documents to be retrieved are met by retrieval queries."""
    return "RETRIEVAL_QUERY" if task_type == "RETRIEVAL_DOCUMENT" else task_type


class ServiceEmbedder:
    """Embeds by a service: ``call(texts, task)`` gives a vector a text. Texts of a batch go in calls of ``size``,
    at most ``parallel`` at once a task; a wrong number of vectors or dimensions is an error."""

    def __init__(self, call, fingerprint: Fingerprint, size: int = 100, parallel: int = 4):
        self.call, self.print, self.size, self.parallel = call, fingerprint, size, parallel

    def _vectors(self, texts: list[str], task: str) -> list[list[float]]:
        from concurrent.futures import ThreadPoolExecutor

        groups = [texts[k : k + self.size] for k in range(0, len(texts), self.size)]
        with ThreadPoolExecutor(self.parallel) as pool:
            got = [v for part in pool.map(lambda g: self.call(g, task), groups) for v in part]
        if len(got) != len(texts) or any(len(v) != self.print.dimensions for v in got):
            raise ValueError("embed: the service gave another number of vectors or dimensions")
        return got

    def embed(self, c: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(self._vectors([t or "" for t in texts], self.print.task_type))

        return run(c)

    def embed_query(self, query: str) -> list[float]:
        return self._vectors([query], query_task(self.print.task_type))[0]

    def fingerprint(self) -> Fingerprint:
        return self.print


class KeywordEmbedder:
    """10 where the lower-cased text contains a word, else 0."""

    def __init__(self, words: tuple[str, ...]):
        self.words = words

    def embed(self, c: Column) -> Column:
        low = F.lower(c)
        return F.array(*[F.when(F.contains(low, F.lit(w)), 10.0).otherwise(0.0) for w in self.words])

    def embed_query(self, query: str) -> list[float]:
        return [10.0 if w in query.lower() else 0.0 for w in self.words]

    def fingerprint(self) -> Fingerprint:
        return Fingerprint("keyword", "+".join(self.words), len(self.words), "RETRIEVAL_DOCUMENT", "1", "declaration")


class HashedEmbedder:
    """Counts of hashed words, of unit length."""

    def __init__(self, dimensions: int = 32):
        self.dimensions = dimensions

    def embed(self, c: Column) -> Column:
        cells = F.transform(tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(self.dimensions)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda i: F.size(F.filter(cells, lambda x: x == i)).cast("double"))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))

    def embed_query(self, query: str) -> list[float]:
        """By the same expressions as the documents, over one row."""
        from pyspark.sql import SparkSession

        row = SparkSession.active().createDataFrame([(query,)], "q string")
        return list(row.select(self.embed(F.col("q")).alias("e")).first()["e"])

    def fingerprint(self) -> Fingerprint:
        return Fingerprint("hashed", "words", self.dimensions, "RETRIEVAL_DOCUMENT", "1", "declaration")
