"""Text functions as Column expressions, with driver-side twins for query literals."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_RUN = r"[\p{L}\p{N}_./-]+"
TERM_LIMIT, TOKEN_LIMIT, QUERY_TOKENS = 12, 8, 8


def trim_all(c: Column) -> Column:
    """Strip every Unicode blank (and the byte order mark) from both ends."""
    return F.regexp_replace(c, _EDGE, "")


def normalize_whitespace(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, "\r\n", "\n"))


def normalize_code(c: Column) -> Column:
    """LF line ends, blank lines at both ends dropped, indentation kept."""
    lf = F.regexp_replace(c, "\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"^(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+$", "")


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("int")


def tokens_of_literal(text: str) -> int:
    """``estimate_tokens`` of a literal."""
    return max(1, -(-len(text) // 4))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def search_terms(c: Column) -> Column:
    """Ordered distinct terms: each token's compact form, then its camel-case parts."""

    def of(token: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        return F.concat(F.array(compact(token)), F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"))

    tokens = F.slice(F.regexp_extract_all(c, F.lit(_RUN), F.lit(0)), 1, TOKEN_LIMIT)
    terms = F.filter(F.flatten(F.transform(tokens, of)), lambda t: F.length(t) >= 2)
    return F.slice(F.array_distinct(terms), 1, TERM_LIMIT)


def tokens(c: Column) -> Column:
    """Index tokens: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def coverage(c: Column, terms: list[str]) -> Column:
    """Share of the terms that the compact text contains; 0 without terms."""
    if not terms:
        return F.lit(0.0)
    packed = compact(c)
    return sum((F.contains(packed, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def compact_literal(s: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}]+", "", s.lower())


def terms_of(query: str) -> list[str]:
    """``search_terms`` of a literal."""
    out: dict[str, None] = {}
    for token in regex.findall(_RUN, query)[:TOKEN_LIMIT]:
        spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token))
        for t in [compact_literal(token), *regex.split(r"[^\p{L}\p{N}]+", spaced.lower())]:
            if len(t) >= 2:
                out.setdefault(t)
    return list(out)[:TERM_LIMIT]


def needs_lexical_match(query: str) -> bool:
    """Whether a query looks like an identifier, for which vector hits alone don't count."""
    q = query.strip()
    if not q or re.search(r"\s", q) or len(compact_literal(q)) < 8:
        return False
    return bool(re.search(r"[0-9_./-]", q) or (re.search("[a-z]", q) and re.search("[A-Z]", q)))


def loose_pattern(s: str) -> str | None:
    """A pattern that finds the compact form of ``s`` with anything but letters and digits between."""
    packed = compact_literal(s)
    return None if len(packed) < 2 else "(?iu)" + r"[^\p{L}\p{N}]*".join(re.escape(x) for x in packed)


def _first(c: Column, query: str, loose: bool = True) -> list[Column]:
    exact = F.nullif(F.instr(F.lower(c), query.lower()), F.lit(0))
    pattern = loose_pattern(query) if loose else None
    return [exact] if pattern is None else [exact, F.nullif(F.instr(c, F.regexp_extract(c, pattern, 0)) * (F.regexp_extract(c, pattern, 0) != "").cast("int"), F.lit(0))]


def anchor(c: Column, query: str, loose: bool = True) -> Column:
    """1-based place of the best match of the query in the text, null without one."""
    q = query.strip()
    tries = _first(c, q, loose) if q else []
    for t in sorted(terms_of(query), key=len, reverse=True):
        tries += _first(c, t, loose)
    return F.coalesce(*tries, F.lit(None).cast("int")) if tries else F.lit(None).cast("int")


def snippet(c: Column, query: str | None = None, most: int = 220) -> Column:
    """A one-line excerpt of at most about ``most`` characters around the query's best match."""
    line = trim_all(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    n = F.length(line)
    cut = F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))
    if not query:
        return F.when(n <= most, line).otherwise(cut)
    lead = max(24, int(most * 0.35))
    at = anchor(line, query)
    begin = F.greatest(F.lit(0), at - 1 - lead)
    end = F.least(n, begin + most)
    start = F.when(end == n, F.greatest(F.lit(0), n - most)).otherwise(begin)
    body = trim_all(line.substr(start + 1, end - start))
    around = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < n, "…").otherwise(""))
    return F.when(n <= most, line).when(at.isNull(), cut).otherwise(around)


def verbatim_quote(c: Column, query: str, most: int = 220) -> Column:
    """As ``snippet``, of exact matches only and without marks or changed blanks."""
    n, at = F.length(c), F.coalesce(anchor(c, query, loose=False), F.lit(1))
    begin = F.greatest(F.lit(0), at - 1 - max(24, int(most * 0.35)))
    end = F.least(n, begin + most)
    start = F.when(end == n, F.greatest(F.lit(0), n - most)).otherwise(begin)
    return F.when(n <= most, trim_all(c)).otherwise(trim_all(c.substr(start + 1, end - start)))


def json_candidate(c: Column) -> Column:
    """The JSON part of a model's reply: fenced, else the outermost object or array, else all of it."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    obj = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    arr = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when(fenced != "", trim_all(fenced)).when(obj != "", obj).when(arr != "", arr).otherwise(trim_all(c))


def normalize_suffixes(values: list[str]) -> list[str]:
    """Path suffixes of a filter: trimmed, lower, with a dot, distinct in order; unusable ones dropped."""
    out: dict[str, None] = {}
    for v in (x.strip().lower() for x in values or []):
        if v and v not in (".", "undefined", ".undefined") and not re.search(r"[\s/\\]", v):
            out.setdefault(v if v.startswith(".") else "." + v)
    return list(out)


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    """LIKE on purpose: an underscore or per cent sign in a suffix is a wildcard."""
    hit = F.lit(not suffixes)
    for s in suffixes:
        hit = hit | F.lower(path).like("%" + s)
    return hit
