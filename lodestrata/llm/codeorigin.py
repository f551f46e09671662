"""Generated, minified and vendored source files, and data saved as code.

Method: the tokens of a file without its comments, identifiers masked, give shingles of eight; MinHash
banding (80 bands of the three least shingles, two of which must be equal) makes candidates, none left
out for being common, so that a library in any number of repositories is found. Bands are made of the
shingles that hold a literal, as the others are mere syntax; files with fewer than ``FEW`` of those have
bands of all their shingles too. Files with equal words are one class, settled by a group-by. Candidates whose least 32 shingles of words speak
for it are verified by their masked shingles, then by the words as written. Clusters across repositories (source keys) are vendored. Clusters within a repository whose
members are equal in form and not in words are a generator's family; so are families of statements
within one file, literals masked too, that are numbered on and on, or that make up nearly all of it.
What is nothing but literals once identifiers are masked is data; code packed into lines without
blanks is minified. A copy whose original isn't in the tables, or a single generated file, forms no
cluster: there the signs by which tools and third parties mark their files (a statement in the head,
a file name, a folder) stand in, and ``evidence`` says so. Of 1,022
pairs of copies (24,790 files) two are expected to be missed by the bands with 64 of them, one with
80 (computed from their similarities). Files of fewer than four distinct shingles are too small to tell
copies by.

Defined results for odd input: null or empty content, prose and settings are no cases; files of
any length are read whole; rows delivered twice count once; a file ingested again under a new id
counts by itself, and copies within one repository aren't vendored; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CODE_SUFFIXES, bucket_pairs, cut, shingle_hashes, word_hashes, words_of
from .nearcopies import MinHash

_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*|^[ \t]*\#(?!\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error|line)\b)[^\n]*)"""
    r"""|(?P<doc>(?:\"\"\"(?:.|\n)*?(?:\"\"\"|\Z))|(?:'''(?:.|\n)*?(?:'''|\Z)))"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
    r"""|(?P<number>\b0[xX][0-9a-fA-F]+\b|\b\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?\w*|\.\d+|\#[0-9a-fA-F]{3,8}\b)"""
    r"""|(?P<name>[^\W\d]\w*|\$\w*)|(?P<mark>[^\s\w])""",
    re.M | re.S,
)

# the groups' numbers
_DOC, _NAME, _MARK = (_TOKEN.groupindex[x] for x in ("doc", "name", "mark"))

# Statements by which tools and third parties sign their files.
_MADE = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?\s?generated (?:file|code|by|from|source)|\b(?:code|file|source|class|automatically) (?:is |was |has been )?(?:automatically |auto-?)?generated\b"
    r"|\bgenerated (?:by|from|with|using|on) |do not (?:edit|modify)|\bproduced by (?:the |tool )?[\w-]+ (?:compiler|generator|\d)|regenerate with|manual edits (?:get|will be|are)|changes (?:will be|here do not|made here) (?:lost|survive)"
)
_OTHERS = re.compile(
    r"(?i)^[\s/*#!;<-]*(?:imported unchanged from|copied (?:from|verbatim from)|vendored from|taken from|originally from|mirror of|[\w.-]+ (?:-|v|version) ?v?\d+\.\d+(?:\.\d+)?\b|[\w.-]+ - version \d|[\w.-]+ - \w+ \d+\.\d+\.\d+ - upstream)|send fixes upstream|\bupstream https?://|\(c\) the [\w.-]+ (?:makers|authors|contributors|team)"
)
_THIRD = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|third[_-]?party|3rd[_-]?party|_?vendored?|external|extern|contrib|deps|ext)/(?=[^/]+/)")
# words of files that speak of such statements
_SPEAKS = re.compile(r"(?i)\b(?:writes|prints|stamps|this script|not here|hand-?written|by hand;?)\b(?!: regenerate)")
# File names that tools give to what they write.
_NAMED_MADE = re.compile(r"(?i)(?:_pb2(?:_grpc)?\.py|\.pb(?:-c)?\.\w+|\.g\.\w+|[._]gen(?:erated)?\.\w+|\.tab\.[ch]|_string\.go|\.min\.(?:js|css)|\.bundle\.(?:js|css)|\.designer\.cs)$")


def profile(text: str) -> dict:
    """What decides about one file: token counts, masked shingles, statement families, evidence."""
    text = text.replace("\r\n", "\n")
    names: list[str] = []
    held = bytearray()
    literal = code = last = 0
    comments: list[tuple[int, str]] = []
    first_code = None
    pieces: list[str] = []
    add, mark = names.append, held.append
    for m in _TOKEN.finditer(text):
        kind = m.lastindex
        if kind <= _DOC:
            start, end = m.span()
            comments.append((start, m[0]))
            pieces.append(text[last:start])
            last = end
            continue
        s = m[0]
        code += len(s)
        if first_code is None:
            first_code = m.start()
        if kind == _NAME:
            add("i")
            mark(0)
        elif kind == _MARK:
            add(s)
            mark(0)
        else:
            literal += len(s)
            add(s)
            mark(1)
    first_code = len(text) if first_code is None else first_code
    pieces.append(text[last:])
    body = "".join(pieces)
    lines = [x for x in body.split("\n") if x.strip()]
    head = "\n".join(s for a, s in comments if a <= first_code)
    return {"tokens": names, "held": held, "literal": literal, "code": code, "body": body, "lines": lines, "head": head}


_LITERALS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|\b0[xX][0-9a-fA-F]+|-?\b\d[\d_.]*\w*|#[0-9a-fA-F]{3,8}")
_NAMES = re.compile(r"[^\W\d][\w$]*")
_NUMBERED = re.compile(r"(?<![A-Za-z0-9.])[fm]?_?(\d{1,4})(?![0-9.]*[A-Za-z0-9.])|_(\d{1,4})\b|\bf(\d{1,4})_|\bm_(\d{1,4})_")


def family_share(lines: list[str]) -> tuple[float, int]:
    """(share of statements in the two largest families, number of statements numbered on)."""
    shaped = [(" ".join(_NAMES.sub("i", _LITERALS.sub("0", s)).split()), s) for s in map(str.strip, lines) if len(s) >= 4]
    shapes = Counter(shape for shape, _ in shaped)
    counters: dict[str, list[int]] = {}
    for shape, s in shaped:
        if shapes[shape] >= 5 and (found := _NUMBERED.findall(s)):
            counters.setdefault(shape, []).append(int(next(x for x in found[0] if x)))
    total = sum(shapes.values())
    if not total:
        return 0.0, 0
    running = 0
    for shape, values in counters.items():
        up = sum(b - a == 1 for a, b in zip(values, values[1:]))
        if len(values) >= 5 and up >= 0.7 * (len(values) - 1):
            running += len(values)
    return sum(n for _, n in shapes.most_common(2)) / total, running


def judge(path: str, language: str, text: str) -> tuple[str | None, str | None, list[str], bytearray]:
    """(reason found in the file itself or None, the evidence, its masked tokens, which are literals)."""
    p = profile(text)
    n = sum(len(x.strip()) for x in p["lines"])
    reason = evidence = None
    longest = max((len(x) for x in p["lines"]), default=0)
    if p["code"]:
        share, running = family_share(p["lines"])
        blanks = sum(x.count(" ") + x.count("\t") for x in p["lines"]) / max(1, sum(map(len, p["lines"])))
        outside = len(re.sub(r"[\s,\[\]{}();:+-]", "", _LITERALS.sub("", p["body"])))
        data = 1 - outside / max(1, len(re.sub(r"\s", "", p["body"])))
        literal = p["literal"] / p["code"]
        stated = "\n".join(x for x in p["head"].split("\n") if _MADE.search(x))
        if running >= 6 and running >= 0.6 * len([x for x in p["lines"] if len(x.strip()) > 3]):
            reason, evidence = "generated", "family"
        elif share >= 0.9 and len(p["lines"]) >= 8 and language not in ("bash", "sh"):
            reason, evidence = ("generated", "family") if data < 0.9 else ("data", "literals")
        elif stated and not _SPEAKS.search(stated):
            reason, evidence = "generated", "head"
        elif data >= 0.85 and literal >= 0.55 and p["code"] >= 400:
            reason, evidence = "data", "literals"
        elif longest >= 250 and blanks < 0.08 and n >= 400 and sum(len(x) for x in p["lines"] if len(x) >= 250) >= 0.6 * n:
            reason, evidence = ("data", "literals") if literal >= 0.6 else ("minified", "packed")
        elif longest >= 400 and literal >= 0.6:
            reason, evidence = "data", "literals"
        if reason is None and _OTHERS.search(p["head"]) is not None:
            reason, evidence = "vendored", "head"
    if reason is None and _NAMED_MADE.search(path):
        reason, evidence = "generated", "name"
    if reason is None and _THIRD.search(path):
        reason, evidence = "vendored", "folder"
    return reason, evidence, p["tokens"], p["held"]


#: Shingles with literals from which a file's bands are made of those alone.
FEW = 24


def bands_of(sketcher: MinHash, shingles: np.ndarray, held: bytearray, k: int) -> np.ndarray:
    """The bands of a file's masked shingles; held: which tokens are literals."""
    before = np.r_[0, np.cumsum(np.frombuffer(held, dtype=np.uint8), dtype=np.int64)]
    speaking = np.unique(shingles[before[k:] > before[:-k]])
    keys = sketcher.keys(speaking)
    return keys if len(speaking) >= FEW else np.union1d(keys, sketcher.keys(shingles))


#: Shingles of a file that say beforehand whether two files could be copies, and the share they must reach.
LOW, SPEAKS = 32, 0.12


def profiles(documents: DataFrame, sketcher: MinHash, k: int = 8, least: int = 4) -> DataFrame:
    """(id, source_key, folder, reason, evidence, same, short, n, low, keys, masked, written) of the code files.

    masked and written: the distinct shingles of masked tokens (n of them), and of three words as
    written; same, short: the latter's digest; low: the least of them; keys: bands, null where the task
    has sent them for the class. Files that aren't compared have none of these.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()  # only saves rows
        for b in batches:
            rows = []
            for i, s, p, lang, t in zip(b["id"], b["source_key"], b["path"], b["language"], b["content"]):
                if not isinstance(t, str) or not t.strip():
                    continue
                path = p or ""
                reason, evidence, tokens, held = judge(path, lang or "", t)
                about = (None, None, 0, None, None, None, None)
                if reason is None or reason == "vendored":
                    shingles = shingle_hashes(word_hashes(tokens), k)
                    form = np.unique(shingles.astype(np.uint32))
                    if len(form) >= least:
                        written = np.unique(shingle_hashes(word_hashes(words_of(t)), 3).astype(np.uint32)).tobytes()
                        same = xxhash.xxh3_128_digest(written)
                        short = int.from_bytes(same[:8], "little", signed=True)
                        keys = None
                        if short not in sent:
                            if len(sent) > 200_000:
                                sent.clear()
                            sent.add(short)
                            keys = bands_of(sketcher, shingles, held, k).view(np.int64)
                        about = (same, short, len(form), written[: 4 * LOW], keys, form.tobytes(), written)
                rows.append((i, s or "", "/".join(path.lower().split("/")[:2]), reason, evidence, *about))
            out = pd.DataFrame(rows, columns=["id", "source_key", "folder", "reason", "evidence", "same", "short", "n", "low", "keys", "masked", "written"])
            yield out.astype({"short": "Int64"})

    suffix = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    code = documents.where(suffix.isin(*CODE_SUFFIXES) & F.col("id").isNotNull() & F.col("content").isNotNull())
    schema = "id long, source_key string, folder string, reason string, evidence string, same binary, short long, n long, low binary, keys array<long>, masked binary, written binary"
    return code.select(F.col("id").cast("long"), "source_key", "path", "language", "content").mapInPandas(run, schema)


def _likeness(pairs: DataFrame, prof: DataFrame) -> DataFrame:
    """(a, b, form, words) of pairs of files: the shares of masked and of written shingles that both have."""

    def share(x: bytes, y: bytes) -> float:
        s, o = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
        both = len(np.intersect1d(s, o, assume_unique=True))
        return both / max(1, len(s) + len(o) - both)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "form": list(map(share, b["ma"], b["mb"])), "words": list(map(share, b["wa"], b["wb"]))})

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(prof.select("id", "masked", "written").join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    both = pairs.join(sets.toDF("a", "ma", "wa"), "a").join(sets.toDF("b", "mb", "wb"), "b")
    return cut(both.select("a", "b", "ma", "mb", "wa", "wb").mapInPandas(run, "a long, b long, form double, words double"))


def _could_be(x: bytes, y: bytes) -> bool:
    """Whether the least shingles of two files let them be copies: their share among the least of both."""
    s, o = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
    least = np.union1d(s, o)[:LOW]
    return len(np.intersect1d(np.intersect1d(s, o, assume_unique=True), least, assume_unique=True)) >= SPEAKS * len(least)


def origins(
    documents: DataFrame, threshold: float = 0.45, form: float = 0.35, k: int = 8, rows: int = 80, order: int = 3, equal: int = 2, hot: int = 64,
    kin: float = 0.8, kin_least: int = 5, family: float = 0.85, family_least: int = 10,
) -> DataFrame:
    """(document_id, reason, evidence) of the files that aren't hand-written here.

    In buckets of more than ``hot`` classes each class first meets the first and the last one: that
    settles most of a family of any size with two pairs a class and band. Then all pairs of a bucket
    meet, but for those that are both settled; large buckets are cut into blocks.
    """
    prof = cut(profiles(documents, MinHash(rows, order), k))
    files = prof.select("id", "source_key", "folder", "reason", "evidence", "same", "short", "n", "low").dropDuplicates(["id"])
    # files of equal words are one class; one that several sources hold is settled and may meet any other
    classes = cut(
        files.where("same is not null").groupBy("same").agg(
            F.min("id").alias("id"), F.min("short").alias("short"), F.xxhash64(F.min("source_key")).alias("source"), (F.min("source_key") != F.max("source_key")).alias("shared"),
            F.min("n").alias("n"), F.min("low").alias("low"),
        )
    )
    bands = prof.where("keys is not null").select(F.explode("keys").alias("key"), "short").repartition("key").distinct()
    # what shares a band with another; classes go by their least id from here on
    crowded = bands.join(bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key")
    crowded = cut(crowded.join(classes.select("short", "id", "source", "shared"), "short").select("key", "id", "source", "shared", "c"))

    @F.pandas_udf("boolean")
    def could_be(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(list(map(_could_be, x, y)), dtype=bool)

    narrow = classes.select("id", "source", "shared", "n", "low")

    def met(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of other sources that could be copies of one another."""
        both = pairs.join(narrow.toDF("a", "sa", "ha", "na", "la"), "a").join(narrow.toDF("b", "sb", "hb", "nb", "lb"), "b")
        both = both.where("sa <> sb or ha or hb").where(F.least("na", "nb") >= form * F.greatest("na", "nb"))
        return both.where(could_be("la", "lb")).select("a", "b")

    def copies(alike: DataFrame) -> DataFrame:
        return alike.where((F.col("form") >= form) & (F.col("words") >= threshold)).select(F.explode(F.array("a", "b")).alias("id"))

    ends = crowded.where(F.col("c") > hot).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    first = crowded.join(ends, "key").select("id", F.explode(F.array("lo", "hi")).alias("o")).where("id <> o")
    first = met(first.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct())
    # one form, many texts in one repository: members are compared with the first of their bucket
    heads = crowded.groupBy("key", "source").agg(F.min("id").alias("a"), F.count("*").alias("m")).where(F.col("m") >= kin_least)
    kindred = crowded.join(heads, ["key", "source"]).where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("m")).where(F.col("m") >= equal).select("a", "b")
    alike = _likeness(cut(first.unionByName(kindred).distinct()), prof)
    settled = classes.where("shared").select("id").unionByName(copies(alike.join(kindred, ["a", "b"], "left_anti"))).distinct()
    flagged = crowded.join(settled.withColumn("done", F.lit(True)), "id", "left").select("key", "id", F.col("done").isNull().alias("open")).repartition("key")
    meeting = bucket_pairs(flagged, only="open")
    rest = met(meeting.groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).agg(F.count("*").alias("m")).where(F.col("m") >= equal).select("a", "b"))
    settled = settled.unionByName(copies(_likeness(cut(rest), prof))).distinct()

    def every(ids: DataFrame) -> DataFrame:
        """All files of the classes."""
        return files.join(classes.join(ids, "id", "left_semi").select("same"), "same", "left_semi").select("id")

    families = cut(alike.join(kindred, ["a", "b"], "left_semi").where((F.col("form") >= kin) & (F.col("words") < kin)).select("a", "b"))
    large = families.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") >= kin_least - 1).select("a")
    relatives = families.join(large, "a", "left_semi").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    folders = files.groupBy("folder").agg(F.count("*").alias("m"), F.count_if(F.col("reason").isin("generated", "minified", "data")).alias("made")).where((F.col("m") >= family_least) & (F.col("made") >= family * F.col("m")))
    beside = files.where("reason is null").join(folders.select("folder"), "folder", "left_semi").select("id")
    parts = [files.where("reason is not null").select("id", "reason", "evidence")]
    parts += [ids.select("id", F.lit(r).alias("reason"), F.lit(e).alias("evidence")) for ids, r, e in ((every(settled), "vendored", "copies"), (every(relatives), "generated", "kin"), (beside, "generated", "beside"))]
    found_ = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # clusters come before what a file says of itself
    weight = F.struct(F.when(F.col("evidence").isin("copies", "kin"), 0).otherwise(1).alias("w"), "reason", "evidence")
    return found_.groupBy(F.col("id").alias("document_id")).agg(F.min(weight).alias("r")).select("document_id", "r.reason", "r.evidence")


def found(documents: DataFrame) -> DataFrame:
    return origins(documents).select("document_id")
