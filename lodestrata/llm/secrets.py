"""Credentials in source text: find them, and redact only their values.

Method: literals near assignment contexts are segmented into dictionary words by Viterbi; what
stays unexplained (the residual) decides. Known hash formats, placeholders and references are
excluded. Formats that announce themselves (fixed prefixes, key blocks) need no assignment.

Defined results for odd input: null or empty text has no secrets; texts of any length are read
whole; a value repeated within a text counts once; rows delivered twice give one row; extra
columns are ignored by ``find_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary

DICTIONARY = "/opt/tokenizers/word_bpe_49k.json"
REDACTED = "[REDACTED_SECRET]"

# Token formats that announce themselves, (issuer's prefix and shape).
_ANNOUNCED = {
    "AKIA": r"\bAKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ASIA": r"\bASIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "gh": r"\bgh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "github_pat_": r"\bgithub_pat_[A-Za-z0-9_]{50,}",
    "glpat-": r"\bglpat-[A-Za-z0-9_-]{20,}",
    "npm_": r"\bnpm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "xox": r"\bxox[abeoprs]-(?:[A-Za-z0-9]+-)+[A-Za-z0-9]{10,}",
    "sk-": r"(?<![A-Za-z0-9_-])sk-(?:[a-z]+[a-z0-9]*-)*[A-Za-z0-9_-]{20,}",
    "sk_": r"(?<![A-Za-z0-9_-])[srp]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "AIza": r"\bAIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "eyJ": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
    "SG.": r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "hooks.slack": r"(?<=hooks\.slack\.com/services/)[A-Z0-9]+/[A-Z0-9]+/[A-Za-z0-9]+",
}
_ANNOUNCED = {k: re.compile(v) for k, v in _ANNOUNCED.items()}

_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN ).)*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)

# Stems of the names that a password goes by, in several languages, and of other credentials.
_PASS_STEMS = ("pass", "pwd", "kennwort", "contrase", "senha", "wachtwoord", "parola d", "密码", "口令")
_KEY_STEMS = ("secret", "token", "credential", "auth", "bearer", "key")
_BEFORE_KEY = re.compile(r"(?:api|access|account|signing|encryption|private|shared|master|client|auth|service|secret|app|storage)[_. -]?$")
_SPOTS = ("://", "login", "basic ", "curl ", "mysql", "sshpass", "-----begin", "akia", "asia", "_", "xox", "sk-", "eyj", "sg.", "aiza", *_PASS_STEMS, *_KEY_STEMS)
_TAIL = re.compile(r"[\w.-]*['\"\]]{0,2}")
_SEP = re.compile(r"\s{0,4}(?::=|=>|=|:)\s{0,4}")
_WORDY_SEP = re.compile(r"(?:\s+[\w'’.-]{1,24}){0,3}\s?(?:[:=]|\bis\b|：)\s{0,3}")
_QUOTED = re.compile(r"(['\"`])((?:\\.|(?!\1)[^\\\n])*)\1")
_BARE = re.compile(r"[^\s'\"`,;<>]+")
_SCHEME = re.compile(r"(?i)^(?:bearer|basic|token|digest|apikey)\s+")
_AUTHORIZATION = re.compile(r"(?i)\b(?:authorization|auth|header)[\w-]*['\"\]]{0,2}\s*[:=]\s*['\"]?(?:bearer|basic|token)\s+([A-Za-z0-9+/=._~-]{8,})|\b(?:bearer|basic)\s+([A-Za-z0-9+/=._~-]{16,})")
_URL_USER = re.compile(r"://[^\s/:@'\"<>]*:([^\s/@'\"<>]+)@")
_URL_PARAM = re.compile(r"[?&;](?:[\w.-]*(?:token|sig|signature|secret|api_?key|access_?key|password|passwd|pwd|auth|credential)|key|sig|code)=([^&\s\"'<>#`)\]]+)", re.I)
_CLI = re.compile(
    r"(?:\bsshpass\s+-p\s*|\bmysql(?:dump|admin)?\b[^\n]*?\s-p(?=\S)|\bpsql\b[^\n]*?--password[= ]|\s--(?:password|token|secret|api-key)[= ])(?:(['\"])(.+?)\1|(\S+))"
    r"|\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[= ]?\s*['\"]?[\w.@-]+:([^\s'\"]+)"
)
_NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(\S+)|\blogin\s+is\s+\S+\s*/\s*(\S+)|\blogin\s*:\s*\S+\s*/\s*(\S+)", re.I)
_SAID = re.compile(r"\s+([^\s'\"`]{6,})")
_CALLED = re.compile(r"\(\s*(['\"])((?:\\.|(?!\1)[^\\\n])+)\1\s*[),]")

_PLACEHOLDER = re.compile(
    r"(?i)\*{3,}|^<.*>$|\[?redacted|\$\{|\{\{|^\$\w|^%\w+%$|x{6,}|^(?:your|my|some|the|insert|enter|put)[_ -]|change[_ -]?me|placeholder|^\.{3}|…|^example|example(?:key)?$|dummy|^null$|^none$|^undefined$|^true$|^false$|_here$|^todo|^fixme|#\{|^@|•"
)
_REFERENCE = re.compile(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:\(|\[|\.$|->|::)|^(?:process\.env|os\.environ|env|secrets|config|vault|var|local|data)[.:/\[]|^!|^arn:|^(?:file|env|vault|ref|kms|ssm|op)://")
_HASHED = re.compile(r"^(?:sha\d{1,3}|md5|crc32|blake\w*|argon2\w*|bcrypt|scrypt|pbkdf2\w*)[-:$(]|^\$(?:2[abxy]?|1|5|6|argon2\w*|pbkdf2\w*|y|scrypt)\$|^\{(?:SSHA|SHA|MD5|CRYPT)", re.I)
_UUID = re.compile(r"^\{?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}?$")
_HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
_UNSAID = re.compile(r"(?i)(?:hash|digest|checksum|fingerprint|integrity|public|pub_?key|length|len|count|limit|size|min|max|ttl|expir\w*|path|file|dir|url|uri|name|env|ref|policy|field|type|hint|label|_id|tokenizer|tokens)$")


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def spotted(text: str) -> bool:
    low = text.lower()
    return any(s in low for s in _SPOTS)


def segment(run: str, words: frozenset[str]) -> int:
    """Letters of one alphabetic run that the cheapest segmentation leaves unexplained (Viterbi)."""
    low, n = run.lower(), len(run)
    best = [0.0] + [math.inf] * n
    lost = [0] * (n + 1)
    for i in range(1, n + 1):
        best[i], lost[i] = best[i - 1] + 4.0, lost[i - 1] + 1
        for j in range(max(0, i - 18), i - 2):
            if (cost := best[j] + 9.0 / (i - j)) < best[i] and low[j:i] in words:
                best[i], lost[i] = cost, lost[j]
    return lost[n]


_RUNS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+|[^\s\w/._-]|[/._-]")


def residual(value: str, words: frozenset[str]) -> tuple[int, int]:
    """(characters not explained by words, kinds of characters used)."""
    left, kinds = 0, set()
    for run in _RUNS.findall(value):
        c = run[0]
        if c in "/._-":
            continue
        if c.isdigit():
            left += len(run)
            kinds.add("digit")
        elif c.isalpha():
            kinds.add("upper" if c.isupper() else "lower")
            if len(run) > 1 and run[1:].islower():
                kinds.add("lower")
            left += segment(run, words) if len(run) > 2 else len(run)
        else:
            left += 1
            kinds.add("mark")
    return left, len(kinds)


def is_secret(value: str, strong: bool, quoted: bool, key_name: bool, words: frozenset[str]) -> bool:
    """Whether a literal in a credential's context grants access."""
    n = len(value)
    if n < 6 or _PLACEHOLDER.search(value) or _REFERENCE.match(value) or _HASHED.match(value) or _UUID.match(value):
        return False
    if value.isdigit() or "://" in value or len(set(value)) < 5:
        return False
    if _HEX.match(value):
        # the format of hashes and ids: only where the name says that it is a key
        return key_name and n >= 16 and any(c.isdigit() for c in value)
    if any(ord(c) > 127 for c in value) or " " in value.strip():
        return False
    left, kinds = residual(value, words)
    if strong:
        return kinds >= 2 and left >= 3 and (quoted or kinds >= 3 or any(c.isdigit() or c in "!#%^*&$?+=~@" for c in value))
    return n >= 16 and kinds >= 2 and left >= max(8, 0.4 * n) and any(c.isdigit() for c in value)


def scan(text: str, words: frozenset[str], open_end: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets in one text, without overlaps.

    open_end: the text may be cut off at its end (a piece of a larger one), so an unquoted value
    that touches the end isn't known to be whole.
    """
    found: list[tuple[int, int, str]] = []
    n = len(text)

    def named(at: int, stem: str) -> None:
        strong = stem in _PASS_STEMS
        if stem == "key" and not _BEFORE_KEY.search(low, max(0, at - 12), at):
            return
        tail = _TAIL.match(text, at + len(stem))
        rest = tail[0].rstrip("'\"]")
        after = text[tail.end() : tail.end() + 1]
        if after not in " \t:=('\"：\r\n" or _UNSAID.search(stem + rest):
            return
        sep = _SEP.match(text, tail.end())
        if sep is not None:
            take(sep.end(), "assignment", strong, not strong)
        elif after == "(":
            m = _CALLED.match(text, tail.end())
            if m and is_secret(m[2], True, True, False, words):
                add(m.start(2), m.end(2), "call")
        elif strong:
            sep = _WORDY_SEP.match(text, tail.end())
            if sep is not None and sep.end() > tail.end():
                take(sep.end(), "assignment", True, False)
            m = _SAID.match(text, tail.end())
            if m:
                value = m[1].rstrip(".,;:)")
                left, kinds = residual(value, words)
                if kinds >= 2 and left >= 5 and any(c.isdigit() or c in "!#%^*_&$?@" for c in value) and is_secret(value, True, False, False, words):
                    add(m.start(1), m.start(1) + len(value), "said")

    def add(start: int, end: int, kind: str) -> None:
        if end > start and not (open_end and end >= n):
            found.append((start, end, kind))

    def take(at: int, kind: str, strong: bool, key_name: bool) -> None:
        m = _QUOTED.match(text, at)
        if m:
            start, value, quoted = m.start(2), m[2], True
        elif (m := _BARE.match(text, at)) is not None:
            start, value, quoted = m.start(), m[0].rstrip(").]}"), False
            if s := re.match(r"(?i)(?:bearer|basic|token|digest)$", value):
                m = _BARE.match(text, min(n, m.end() + 1))
                if m is None:
                    return
                start, value, strong = m.start(), m[0].rstrip(").]}"), False
        else:
            return
        if s := _SCHEME.match(value):
            start, value, strong = start + s.end(), value[s.end() :], False
        if is_secret(value, strong, quoted, key_name, words):
            add(start, start + len(value), kind)

    low = lowered(text)
    if "-----BEGIN" in text:
        for m in _BLOCK.finditer(text):
            if m.end() - m.start() > 150:
                found.append((m.start(), m.end(), "private_key"))
    for literal, pattern in _ANNOUNCED.items():
        if literal in text:
            for m in pattern.finditer(text):
                value = m[0]
                if not _PLACEHOLDER.search(value) and len(set(value)) >= 8 and (literal in ("AKIA", "ASIA") or residual(value, words)[0] >= 6):
                    add(m.start(), m.end(), "token")
    if "://" in text:
        if "@" in text:
            for m in _URL_USER.finditer(text):
                if is_secret(m[1], True, True, True, words):
                    add(m.start(1), m.end(1), "url_password")
        if "=" in text and "?" in text:
            for m in _URL_PARAM.finditer(text):
                if "://" in text[max(0, m.start() - 2000) : m.start()] and is_secret(m[1], False, False, True, words):
                    add(m.start(1), m.end(1), "url_token")
    if "bearer" in low or "basic " in low or "authorization" in low:
        for m in _AUTHORIZATION.finditer(text):
            k = 1 if m[1] else 2
            if is_secret(m[k], False, False, True, words) or (len(m[k]) >= 12 and _base64_pair(m[k], words)):
                add(m.start(k), m.end(k), "authorization")
    if "curl" in low or "sshpass" in low or "sql" in low or " --" in text or "wget" in low:
        for m in _CLI.finditer(text):
            k = next(k for k in (2, 3, 4) if m[k])
            if is_secret(m[k], True, k == 2, False, words):
                add(m.start(k), m.end(k), "command_line")
    if "login" in low:
        for m in _NETRC.finditer(text):
            k = next(k for k in (1, 2, 3) if m[k])
            if is_secret(m[k], True, True, False, words):
                add(m.start(k), m.end(k), "login")
    for stem in _PASS_STEMS + _KEY_STEMS:
        at = low.find(stem)
        while at >= 0:
            named(at, stem)
            at = low.find(stem, at + len(stem))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def _base64_pair(value: str, words: frozenset[str]) -> bool:
    """Whether basic authentication's text decodes to user:password."""
    import base64
    import binascii

    try:
        user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return bool(user and colon) and is_secret(password, True, True, False, words)


def _held(text: str, words: frozenset[str], known: list[str] | None, piece: bool) -> dict[str, str]:
    """Kind by secret value of a text; known: the secrets of the text that a piece was cut from."""
    seen: dict[str, str] = {}
    of_parent = set() if known is None else set(known)
    if spotted(text):
        for s, e, kind in scan(text, words, open_end=piece and not of_parent):
            if of_parent and (s < 2 or e >= len(text) - 1) and text[s:e] not in of_parent:
                continue
            seen.setdefault(text[s:e], kind)
    for k in of_parent:
        if k in text:
            seen.setdefault(k, "parent")
    return seen


def find_secrets(df: DataFrame, id_col: str, text_col: str, dictionary: str = DICTIONARY, parent_col: str | None = None, known_col: str | None = None) -> DataFrame:
    """(record_id, secret, kind) of each record; with ``parent_col`` also parent_id.

    known_col: an array of the secrets of the text that a piece was cut from. A piece then also
    gets those of them that stand wholly in it though their context was cut away, and values that
    touch its ends count only if they are among them.
    """
    schema = "record_id long, parent_id long, secret string, kind string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(dictionary)
        for b in batches:
            rows = []
            known = b["k"] if known_col else [None] * len(b)
            for i, p, t, ks in zip(b["i"], b["p"], b["t"], known):
                if not isinstance(t, str) or not t:
                    continue
                seen = _held(t, words, ks, known_col is not None)
                rows += [(i, p, s, k) for s, k in seen.items()]
            yield pd.DataFrame(rows, columns=["record_id", "parent_id", "secret", "kind"])

    cols = [F.col(id_col).cast("long").alias("i"), (F.col(parent_col) if parent_col else F.col(id_col)).cast("long").alias("p"), F.col(text_col).alias("t")]
    if known_col:
        cols.append(F.col(known_col).alias("k"))
    return df.select(*cols).where(F.col("i").isNotNull()).mapInPandas(run, schema).dropDuplicates(["record_id", "secret"])


def redact_secrets(df: DataFrame, text_col: str, out_col: str | None = None, dictionary: str = DICTIONARY) -> DataFrame:
    """``df`` with only the secret values of ``text_col`` replaced; null stays null, all columns stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        words = vocabulary(dictionary)

        def one(t):
            if not isinstance(t, str) or not t or not spotted(t):
                return t
            out, at = [], 0
            for s, e, _ in scan(t, words):
                out += [t[at:s], REDACTED]
                at = e
            return "".join(out) + t[at:]

        return texts.map(one)

    return df.withColumn(out_col or text_col, clean(F.col(text_col)))


def redact_everywhere(df: DataFrame, text_col: str, dictionary: str = DICTIONARY, known_col: str | None = None) -> DataFrame:
    """``df`` with every occurrence of the values that ``find_secrets`` yields for the record replaced, the longest first."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, known: pd.Series) -> pd.Series:
        words = vocabulary(dictionary)

        def one(t, ks):
            if not isinstance(t, str) or not t:
                return t
            values = sorted(_held(t, words, ks, known_col is not None), key=lambda v: (-len(v), v))
            return re.sub("|".join(map(re.escape, values)), lambda _: REDACTED, t) if values else t

        return pd.Series([one(t, ks) for t, ks in zip(texts, known)], index=texts.index, dtype=object)

    known = F.col(known_col) if known_col else F.lit(None).cast("array<string>")
    return df.withColumn(text_col, clean(F.col(text_col), known))


def _known(whole: DataFrame) -> DataFrame:
    return whole.groupBy("record_id").agg(F.collect_set("secret").alias("known")).withColumnRenamed("record_id", "document_id")


def redacted(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_table, id, path, content) of both tables, secrets replaced; chunks have no path."""
    known = _known(find_secrets(documents, "id", "content"))
    pieces = redact_everywhere(chunks.select("id", "document_id", "content").join(known, "document_id", "left"), "content", known_col="known")
    whole = redact_everywhere(documents.select("id", "path", "content"), "content")
    return (
        whole.select(F.lit("kb_documents").alias("record_table"), "id", "path", "content")
        .unionByName(pieces.select(F.lit("chunks").alias("record_table"), "id", F.lit(None).cast("string").alias("path"), "content")).distinct()
    )


def found(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of both tables with the secrets that stand in them."""
    whole = find_secrets(documents, "id", "content")
    pieces = find_secrets(chunks.select("id", "document_id", "content").join(_known(whole), "document_id", "left"), "id", "content", known_col="known")
    return (
        whole.select(F.lit("kb_documents").alias("record_table"), "record_id", "secret")
        .unionByName(pieces.select(F.lit("chunks").alias("record_table"), "record_id", "secret"))
    )
