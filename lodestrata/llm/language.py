"""Language of documents and of their blocks, with a calibrated confidence.

Method: a text's hashed subwords (character runs of several lengths within words) are averaged
over learned embeddings and put through a linear softmax, trained by stochastic gradient descent in
numpy. The training rows are a bounded sample of labelled documents (``sample`` per language,
chosen by a hash of the id); labels are noisy, so the model is fitted twice, the second time
without the rows that the first contradicts. Temperature and the rejection threshold are set on a
held-out part of the sample.

Defined results for odd input: null or blank text has no blocks; blocks without letters, and blocks
whose confidence is below the threshold, get no language (null); labels are compared after trimming,
by their first subtag, three-letter codes included; an unknown label names no language; with fewer
than two languages in the sample nothing is classified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "it", "nl")
# Three-letter codes of these languages.
_THREE = {
    "eng": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl",
}
_GAP = re.compile(r"\n(?:[^\S\n]*\n)+")


def label_code(label: Column) -> Column:
    """The language that a label names, or null."""
    first = F.split(F.lower(F.trim(F.regexp_replace(label, r"^[\s ]+|[\s ]+$", ""))), "[-_]").getItem(0)
    three = F.create_map(*[F.lit(x) for kv in _THREE.items() for x in kv])
    return F.coalesce(F.try_element_at(three, first), F.when(first.isin(*LANGUAGES), first))


def blocks(text: str) -> list[str]:
    """What a text gives when cut at every run of blank lines; the first is numbered 1."""
    return _GAP.split(text.replace("\r\n", "\n"))


_TICKED = re.compile(r"`[^`\n]*`|https?://\S+")
# Han characters stand alone, other letters form words
_LETTERS = re.compile(r"[\u3400-\u9fff]|[^\W\d_\u3400-\u9fff]+")


def letters(text: str) -> list[str]:
    """The words that carry language: no code spans, addresses, digits or marks."""
    t = text.lower()
    if "`" in t or "://" in t:
        t = _TICKED.sub(" ", t)
    return _LETTERS.findall(t)


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of each subword: runs of 2, 3 and 5 characters within a word, its ends marked."""
    s = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    blank = s == 32
    number = np.cumsum(blank) - 1
    hashed, owner = [], []
    with np.errstate(over="ignore"):
        p2 = s[:-1] * np.uint64(0x9E3779B1) + s[1:]
        hashed.append(p2 * np.uint64(0xC2B2AE3D27D4EB4F))
        owner.append(number[:-1])
        if len(s) > 2:
            p3 = p2[:-1] * np.uint64(0x85EBCA77) + s[2:]
            ok = ~blank[1:-1]
            hashed.append((p3 * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[ok])
            owner.append(number[:-2][ok])
        if len(s) > 4:
            p5 = (p3[:-2] * np.uint64(0x27D4EB2F) + s[3:-1]) * np.uint64(0x165667B1) + s[4:]
            ok = ~(blank[1:-3] | blank[2:-2] | blank[3:-1])
            hashed.append((p5 * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2))[ok])
            owner.append(number[:-4][ok])
    h = np.concatenate(hashed)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) & (buckets - 1), np.concatenate(owner)


class Model:
    """Averaged embeddings and a linear softmax; at use both collapse into one table of logits a
    subword, and a word's sum of them is kept once computed (a cache, emptied when it grows large)."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, codes: list[str], threshold: float):
        self.table, self.bias, self.codes, self.threshold = table, bias, codes, threshold
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((0, len(codes) + 1), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "sums")} | {"rows": {}, "sums": self.sums[:0]}

    def _learn(self, words: list[str]) -> None:
        if len(self.rows) + len(words) > 400_000:
            self.rows, self.sums = {}, self.sums[:0]
        grams, owner = subwords(words, len(self.table))
        looked = self.table[grams]
        new = np.empty((len(words), len(self.codes) + 1), dtype=np.float32)
        for c in range(len(self.codes)):
            new[:, c] = np.bincount(owner, weights=looked[:, c], minlength=len(words))[: len(words)]
        new[:, -1] = np.bincount(owner, minlength=len(words))[: len(words)]
        at = len(self.rows)
        if at + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums[:at], np.zeros((at + 2 * len(words), self.sums.shape[1]), dtype=np.float32)])
        self.sums[at : at + len(words)] = new
        self.rows.update(zip(words, range(at, at + len(words))))

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of the codes, whether the text has letters) of each text."""
        out = np.zeros((len(texts), len(self.codes)))
        has = np.zeros(len(texts), dtype=bool)
        for lo in range(0, len(texts), 4000):
            split = [letters(t) for t in texts[lo : lo + 4000]]
            missing = set().union(*split).difference(self.rows)
            if missing:
                if len(self.rows) + len(missing) > 400_000:
                    missing = set().union(*split)
                self._learn(sorted(missing))
            sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            used = np.flatnonzero(sizes)
            if not len(used):
                continue
            index = np.fromiter((i for ws in split for i in map(self.rows.__getitem__, ws)), dtype=np.int64, count=int(sizes.sum()))
            total = np.add.reduceat(self.sums[index], np.r_[0, np.cumsum(sizes[used])[:-1]], axis=0)
            z = total[:, :-1] / total[:, -1:] + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[lo + used] = z / z.sum(axis=1, keepdims=True)
            has[lo + used] = True
        return out, has


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a fitted model to a folder, so that later runs needn't fit it: one row of logits a bucket."""
    rows = [(-1, [float(x) for x in (*model.bias, model.threshold)]), *enumerate(model.table.tolist())]
    frame = spark.createDataFrame(rows, "bucket long, logits array<double>").withColumn("codes", F.when(F.col("bucket") < 0, ",".join(model.codes)))
    frame.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """A model as ``save_model`` wrote it: as many rows as it has buckets."""
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["bucket"])
    about = rows[0]["logits"]
    return Model(np.array([r["logits"] for r in rows[1:]], dtype=np.float32), np.array(about[:-1], dtype=np.float32), rows[0]["codes"].split(","), about[-1])


def train(texts: list[str], labels: list[str], dim: int = 16, buckets: int = 1 << 16, epochs: int = 8, rate: float = 0.15, seed: int = 7) -> Model | None:
    """Fit on (text, label) rows with some wrong labels."""
    codes = sorted(set(labels))
    if len(codes) < 2:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([codes.index(x) for x in labels])
    grams, shares = [], []
    for t in texts:
        words = letters(t)
        g, n = np.unique(subwords(words, buckets)[0] if words else np.empty(0, dtype=np.int64), return_counts=True)
        grams.append(g)
        shares.append((n / max(1, n.sum())).astype(np.float32))
    keep = np.array([i for i, g in enumerate(grams) if len(g) > 20])
    if len(keep) < 2:
        return None
    held = rng.random(len(keep)) < 0.2

    def fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
        w = rng.normal(0, 0.3, (dim, len(codes))).astype(np.float32)
        bias = np.zeros(len(codes), dtype=np.float32)
        present = np.bincount(y[rows], minlength=len(codes)) / len(rows)
        weight = np.minimum(1 / np.maximum(present * len(codes), 1e-3), 5).astype(np.float32)
        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            for i in rng.permutation(rows):
                g, share = grams[i], shares[i]
                own = e[g]
                mean = share @ own
                z = mean @ w + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                p *= step * weight[y[i]]
                # a subword's step goes by its share of the text; scaled up, as shares are small
                e[g] = own - (60 * share)[:, None] * (w @ p)[None, :]
                w -= np.outer(mean, p)
                bias -= p
        return e, w, bias

    def logits(model: tuple, rows: np.ndarray) -> np.ndarray:
        e, w, bias = model
        t = e @ w
        return np.stack([shares[i] @ t[grams[i]] + bias for i in rows])

    fitted = fit(keep[~held])
    clean = keep[logits(fitted, keep).argmax(axis=1) == y[keep]]
    if len(set(y[clean])) >= 2:
        fitted = fit(np.intersect1d(clean, keep[~held]) if len(set(y[np.intersect1d(clean, keep[~held])])) >= 2 else clean)
    e, w, bias = fitted
    test = np.intersect1d(clean, keep[held])
    test = test if len(test) >= 20 else clean
    z = logits(fitted, test)
    best, scale = np.inf, 1.0
    for s in np.geomspace(0.25, 64, 33):
        q = z * s
        loss = float(np.mean(np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1)) + q.max(axis=1) - q[np.arange(len(test)), y[test]]))
        if loss < best - 1e-4:
            best, scale = loss, s
    q = z * scale
    p = np.exp(q - q.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p[np.arange(len(test)), y[test]])
    threshold = float(min(0.5, max(0.3, right[len(right) // 200])))
    return Model((e @ w * scale).astype(np.float32), (bias * scale).astype(np.float32), codes, threshold)


def labelled_sample(documents: DataFrame, sample: int, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """At most about ``sample`` (text, label) rows a language, the same ones at every run."""
    code = label_code(F.col(label_col))
    counts = {r["c"]: r["n"] for r in documents.select(code.alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, float(min(1.0, sample / n)))])
    draw = F.abs(F.xxhash64(F.col(id_col), F.lit(17))) % 1_000_000
    rows = (
        documents.select(F.col(text_col).alias("t"), code.alias("c"), draw.alias("d"))
        .where("c is not null and t is not null").where(F.col("d") < F.try_element_at(share, F.col("c")) * 1_000_000)
        .select("t", "c").limit(sample * len(LANGUAGES) * 2).collect()
    )
    return [(r["t"], r["c"]) for r in rows]


def fit(documents: DataFrame, sample: int = 300, per_text: int = 3) -> Model | None:
    """Train on whole blocks of the sampled documents (up to ``per_text`` blocks of each)."""
    texts, labels = [], []
    for t, c in labelled_sample(documents, sample):
        body = [b for b in blocks(t) if len(b.strip()) >= 60 and not b.strip().startswith(("#", "```"))]
        for b in body[:per_text]:
            texts.append(b)
            labels.append(c)
    return train(texts, labels) if texts else None


_HAN, _LATIN = re.compile(r"[\u3400-\u9fff]"), re.compile(r"[A-Za-z]")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")


def _pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a block, blank ones left out."""
    ends = [m.span() for m in _SENTENCES.finditer(text)]
    spans = zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)])
    return [(s, e) for s, e in spans if text[s:e].strip()]


def _texts(b: pd.DataFrame, every: bool) -> tuple[list, list, list, list]:
    """(ids, block numbers, trimmed texts, whether fenced) of the blocks of a batch (i, t)."""
    ids, numbers, texts, fenced = [], [], [], []
    for i, t in zip(b["i"], b["t"]):
        if not isinstance(t, str):
            continue
        parts = blocks(t)
        odd = [k for k, x in enumerate(parts) if "```" in x and sum(y.lstrip().startswith("```") for y in x.split("\n")) % 2]
        # blocks from an opening fence to the one that closes it
        within = {k for x, y in zip(odd[::2], odd[1::2]) for k in range(x + 1, y + 1)}
        for k, block in enumerate(parts):
            s = block.strip()
            code = k in within or s.startswith("```")
            if not s or not every and (code or len(s) < 60 or s.startswith("#")):
                continue
            ids.append(i)
            numbers.append(k + 1)
            texts.append(s)
            fenced.append(code)
    return ids, numbers, texts, fenced


def _judge(m: Model | None, texts: list[str], mixed: float) -> tuple[list[tuple[str | None, float]], dict[int, list[tuple[int, int, np.ndarray]]]]:
    """(language, confidence) of each text, and of the unsure ones (start, end, probabilities) of their sentences."""
    got: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
    parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    if not m or not texts:
        return got, parts
    p, has = m.many(texts)
    best, top = p.argmax(axis=1), p.max(axis=1)
    got = [(m.codes[k] if h and v >= m.threshold else None, float(v)) for k, v, h in zip(best, top, has)]
    scripts = np.fromiter((_HAN.search(x) is not None and _LATIN.search(x) is not None for x in texts), dtype=bool, count=len(texts))
    unsure = [(n, s, e) for n in np.flatnonzero(has & ((top < mixed) | scripts)) for s, e in _pieces(texts[n])]
    if unsure:
        q, known = m.many([texts[n][s:e] for n, s, e in unsure])
        for (n, s, e), row, h in zip(unsure, q, known):
            parts.setdefault(n, []).append((s, e, row if h else row * 0))
    for n, rows in parts.items():
        # the mean of the sentences' calibrated probabilities, by characters
        v = sum(row * (e - s) for s, e, row in rows)
        if total := float(np.sum(v)):
            k = int(np.argmax(v))
            got[n] = (m.codes[k] if v[k] / total >= m.threshold else None, float(v[k]) / total)
    return got, parts


def detect(documents: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id", mixed: float = 0.9, every: bool = False) -> DataFrame:
    """(doc_id, block_no, n_chars, language_code, confidence, fenced) of each plain block, or of every block that isn't blank.

    Plain blocks have 60 characters or more, start with neither # nor a fence and stand outside
    fences. A fence that nothing closes ends with its block.

    A block whose confidence is below ``mixed``, or that mixes scripts, is split into sentences, whose
    languages then vote by their characters.
    """
    schema = "doc_id long, block_no long, n_chars long, language_code string, confidence double, fenced boolean"
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, numbers, texts, fenced = _texts(b, every)
            got, _ = _judge(held.value, texts, mixed)
            if ids:
                codes = pd.Series([c for c, _ in got], dtype=object)
                yield pd.DataFrame({"doc_id": ids, "block_no": numbers, "n_chars": [len(t) for t in texts], "language_code": codes, "confidence": [p for _, p in got], "fenced": fenced})

    picked = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    return picked.mapInPandas(run, schema)


def merged(sentences: list[tuple[int, int, int, float]], sure: float = 0.8, short: int = 60, surer: float = 0.95) -> list[tuple[int, int, int | None, list[int]]]:
    """(start, end, code number or None, numbers of sentences): runs of sentences (start, end, best code, its probability) in one language.

    A sentence that isn't ``sure`` (one below ``short`` characters: ``surer``) goes with its neighbour.
    """
    out: list[list] = []
    for n, (s, e, k, top) in enumerate(sentences):
        code = k if top >= (sure if e - s >= short else surer) else None
        if out and (code is None or out[-1][2] in (None, code)):
            out[-1][1], out[-1][2] = e, out[-1][2] if code is None else code
            out[-1][3].append(n)
        else:
            out.append([s, e, code, [n]])
    return [tuple(x) for x in out]


def segments(documents: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, block_no, segment_no, start_at, n_chars, language_code, confidence) of all text outside fences.

    Every block is judged by its sentences: one in one language is one segment, a mixed one has a
    segment a run of sentences in one language. start_at counts from 0 within the trimmed block;
    confidence is the mean of the sentences' calibrated probabilities, by characters. Segments without
    a language have null and confidence 0.
    """
    schema = "doc_id long, block_no long, segment_no int, start_at long, n_chars long, language_code string, confidence double"
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            ids, numbers, texts, fenced = _texts(b, True)
            spans = [[] if code else _pieces(t) for t, code in zip(texts, fenced)]
            said = [t[s:e] for t, parts in zip(texts, spans) for s, e in parts]
            if m and said:
                p, _ = m.many(said)
                best, top = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
            else:
                p, best, top = np.zeros((len(said), 1)), [0] * len(said), [0.0] * len(said)
            rows, at = [], 0
            for i, no, parts in zip(ids, numbers, spans):
                n = len(parts)
                judged = [(s, e, k, v) for (s, e), k, v in zip(parts, best[at : at + n], top[at : at + n])]
                for k, (s, e, code, held_) in enumerate(merged(judged)):
                    share = 0.0
                    if code is not None:
                        size = [judged[x][1] - judged[x][0] for x in held_]
                        share = sum(z * p[at + x, code] for z, x in zip(size, held_)) / sum(size)
                    rows.append((i, no, k, s, e - s, None if code is None else m.codes[code], float(share)))
                at += n
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    picked = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    return picked.mapInPandas(run, schema)


def document_languages(documents: DataFrame, found_blocks: DataFrame) -> DataFrame:
    """(doc_id, language_code, confidence): the language of most characters of each document.

    Fenced blocks count only where no other block has a language; where none has one, it is null
    with confidence 0.
    """
    by = found_blocks.where("language_code is not null").groupBy("doc_id", "fenced", "language_code").agg(F.sum("n_chars").alias("n"), F.sum(F.col("confidence") * F.col("n_chars")).alias("w"))
    sides = by.groupBy("doc_id", "fenced").agg(F.max(F.struct("n", "language_code", "w")).alias("top"), F.sum("n").alias("total"))
    top = sides.groupBy("doc_id").agg(F.min_by(F.struct("top", "total"), "fenced").alias("of"))
    ids = documents.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    return ids.join(top, "doc_id", "left").select("doc_id", F.col("of.top.language_code").alias("language_code"), F.coalesce(F.round(F.col("of.top.w") / F.col("of.total"), 6), F.lit(0.0)).alias("confidence"))


def found(documents: DataFrame, sample: int = 300, model: Model | None = None) -> DataFrame:
    """(doc_id, block_no, language_code) of the blocks in another language than the label names; without a model one is fitted."""
    named = documents.select("doc_id", "text", label_code(F.col("lang")).alias("named"))
    got = detect(documents, model or fit(documents, sample)).where("language_code is not null")
    labels = named.select(F.col("doc_id"), "named").distinct()
    return got.join(labels, "doc_id").where(F.col("named").isNull() | (F.col("named") != F.col("language_code"))).select("doc_id", "block_no", "language_code").distinct()
