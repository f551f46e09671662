"""Token counts by a public byte-level BPE vocabulary file, whose path is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this vocabulary.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(documents: DataFrame, path: str = VOCABULARY, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens, copy_key): source trimmed and lower-cased; copy_key: equal for equal word sequences.

    Null or empty text has 0 tokens; a document delivered twice counts once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["t"]]
            tokens = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            keys = [xxhash.xxh3_64_intdigest(" ".join(words_of(t)).encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]
            yield pd.DataFrame({"doc_id": b["i"], "source": b["s"], "tokens": tokens, "copy_key": keys})

    picked = documents.select(F.col(id_col).cast("long").alias("i"), F.lower(F.trim(F.col(source_col))).alias("s"), F.col(text_col).alias("t"))
    rows = picked.where("i is not null").mapInPandas(run, "doc_id long, source string, tokens long, copy_key long")
    return rows.dropDuplicates(["doc_id"])
