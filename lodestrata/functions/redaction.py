"""Redaction of secrets in URLs, texts and nested values, and URL identity."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[REDACTED]"
# Query parameters whose values are secret.
SENSITIVE = (
    "token", "access_token", "api_key", "key", "signature", "sig", "auth", "authorization", "x-amz-signature", "x-amz-credential", "x-amz-security-token",
)
_URL_IN_TEXT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s<>'\"`]+")
_PARTS = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):\/\/([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)


def redact_params(raw: str, everything: bool = False) -> str:
    out = []
    for pair in raw.split("&"):
        name, eq, value = pair.partition("=")
        if eq and value:
            secret = everything or unquote(name).lower() in SENSITIVE
            value = MASK if secret else quote(unquote(value.replace("+", " ")), safe="-_.!~*'()")
        out.append(name + eq + value)
    return "&".join(out)


def redact_url(raw: str, drop_fragment: bool = False) -> str | None:
    """The URL without its secrets; null if it is none."""
    m = _PARTS.match(raw.strip())
    if not m:
        return None
    scheme, authority, path, query, fragment = m.groups()
    user, at, host = authority.rpartition("@")
    if scheme.lower() in ("http", "https", "ftp", "ws", "wss"):
        host, path = host.lower(), path or "/"
    out = f"{scheme.lower()}://{MASK + '@' if at and user else ''}{host}{path}"
    if query is not None and query != "":
        out += "?" + redact_params(query)
    if fragment and not drop_fragment:
        out += "#" + (redact_params(fragment, everything=True) if re.search("[=&]", fragment) else MASK)
    return out


def network_url(raw: str) -> str:
    """A URL to call with: without user and password, sensitive parameters and fragment."""
    m = _PARTS.match(raw.strip())
    if not m:
        return raw.strip()
    scheme, authority, path, query, _ = m.groups()
    user, at, host = authority.rpartition("@")
    # over ssh the user name is part of the address
    kept = f"{user.partition(':')[0]}@" if at and scheme.lower() == "ssh" else ""
    pairs = [p for p in (query or "").split("&") if p and unquote(p.partition("=")[0]).lower() not in SENSITIVE]
    return f"{scheme.lower()}://{kept}{host}{path}" + ("?" + "&".join(pairs) if pairs else "")


def lookup_path(path: str) -> str:
    """A document's path as it is stored: redacted if it is a URL, else with forward slashes and no leading dot."""
    if re.match(r"[A-Za-z]+://", path):
        return redact_url(path) or path
    return re.sub(r"^\./", "", path.replace("\\", "/"))


def redact_text_literal(text: str) -> str:
    return _URL_IN_TEXT.sub(lambda m: redact_url(m[0]) or m[0], text)


def redact_deep(value):
    """Redact every string of a nested value."""
    if isinstance(value, str):
        return redact_text_literal(value)
    if isinstance(value, dict):
        return {k: redact_deep(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redact_deep(v) for v in value]
    return value


def _mapped(f):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f(v) if isinstance(v, str) else None)

    return run


def redact_urls(c: Column) -> Column:
    """Locator as stored: redacted if it is a URL, else unchanged."""
    return _mapped(lambda v: redact_url(v) or v)(c)


def redact_text(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("://")), _mapped(redact_text_literal)(c)).otherwise(c)


def page_identity(c: Column) -> Column:
    """A page's identity: redacted, without fragment."""
    return _mapped(lambda v: redact_url(v, drop_fragment=True) or v)(c)


def absolute_url(value: str, base: str) -> str | None:
    """Resolve a link; only http and https count, the fragment is dropped."""
    try:
        url = urljoin(base, value.strip()).split("#", 1)[0]
        return url if urlsplit(url).scheme in ("http", "https") and urlsplit(url).netloc else None
    except ValueError:
        return None


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def url_path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def chunk_path(url: Column) -> Column:
    """The path under which a page's chunks are stored."""
    p = url_path(url)
    named = F.regexp_replace(p, "^/+", "")
    dotted = F.regexp_like(F.element_at(F.split(p, "/"), -1), F.lit(r"^.+\.[^.]+$"))
    return F.when(p == "/", "index.md").when(dotted, named).otherwise(F.concat(named, F.lit(".md")))


# Extensions and paths that hold no page.
NON_HTML = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "mjs", "cjs", "map", "json", "xml", "pdf", "zip", "gz", "tgz", "tar", "rar", "7z",
    "woff", "woff2", "ttf", "otf", "eot", "mp4", "webm", "mp3", "wav",
)
NOISE_PATHS = ("/robots.txt", "/sitemap.xml")
NOISE_PREFIXES = ("/assets/", "/static/", "/img/", "/images/", "/_next/", "/favicon")


def excluded_by_default(url: Column) -> Column:
    p = F.lower(url_path(url))
    noise = p.isin(*NOISE_PATHS) | F.regexp_extract(p, r"\.([a-z0-9]+)$", 1).isin(*NON_HTML)
    for prefix in NOISE_PREFIXES:
        noise = noise | p.startswith(prefix)
    return noise


def scope_prefix(root: str) -> str:
    """The path prefix that a crawl from ``root`` stays in."""
    path = urlsplit(root).path or "/"
    last = path.rsplit("/", 1)[-1]
    return path[: len(path) - len(last)] if "." in last else path.rstrip("/") + "/"


def in_scope(url: Column, root: str) -> Column:
    parts, prefix = urlsplit(root), scope_prefix(root)
    p = url_path(url)
    same = origin(url) == f"{parts.scheme}://{parts.netloc}".lower()
    return same & (F.lit(prefix == "/") | p.startswith(prefix) | (p == (parts.path or "/")))


def failure_reason(error: Column) -> Column:
    e = F.lower(error)
    return (
        F.when(e.contains("timeout") | e.contains("timed out"), "timeout")
        .when(e.contains("too short") | e.contains("内容过短"), "too_short")
        .when(e.contains("json"), "parse_error")
        .otherwise("fetch_error")
    )
