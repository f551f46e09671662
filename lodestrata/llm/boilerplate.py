"""Main content of web pages: delete what neighbouring pages of a host share.

Method: nearest-URL page differencing. Pages of a host are sorted by URL path, so that the nearest
ones stand beside each other; each page's normalised lines are aligned with those of its
neighbours by longest common subsequence. Lines shared with enough neighbours are the site's
furniture. For the alignment, digits are equal, a line of nothing but links into the page's own
host is equal to its like, and the page's own title at the end of a breadcrumb is equal to any
other's: what changes from page to page in a menu or a trail doesn't hide it. Blocks (runs of lines
without a blank line) then settle the rest: the titles listed directly under a heading that isn't
the article's own belong to the furniture although their words change from page to page. Fenced
code, the page's title and headings that stand alone are kept.

A page's neighbours are the ``window`` nearest runs of pages on either side, where pages in a row
with equal articles (heading and long lines) are one run, and a page never meets its own run. They
don't depend on the number of pages or of partitions: pages are sorted into ranges, and each range
is also given the first pages of the runs around it. A task keeps 2 x ``window`` + 1 pages, however
large the host or the run is.

Defined results for odd input: pages whose Markdown is null or blank have no Markdown lines; with
``html`` their lines are made from the html view instead; a page delivered twice gives its lines
once and isn't its own neighbour; a host with a single page is judged by its blocks alone; null URLs
and URLs without a path are hosts and paths like others; lines are counted from 1 and split at \n;
a page of nothing but furniture has an empty body; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_DIGITS = re.compile(r"\d+")
_LINK = re.compile(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]\(([^()\s]*(?:\([^()]*\)[^()\s]*)*)\)")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_HEAD = re.compile(r"^\s{0,3}(?:#{1,6}\s+\S|\*\*[^*]+\*\*\s*:?$|__[^_]+__$)")
_RULE = re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,}|={3,}|(?:[-*_]\s){2,}[-*_])\s*$")
_SENTENCE = re.compile(r"[.!?;:。！？；：…`}{]\s*(?:\[\d+\])?$|[.!?]\s+\S|。")
_JOIN = re.compile(r"\s+(?:[»›>/|·•→]|::)\s+")
_BARS = re.compile(r"[|·•/»›>,\s\-–—]+")


def normal(line: str) -> str:
    return _DIGITS.sub("0", line.strip().lower())


def host_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty if it can't be read."""
    try:
        parts = urlsplit((url or "").strip())
    except ValueError:
        return "", url or ""
    return parts.netloc.lower().rpartition("@")[2], parts.path


def shared(own: list[str], other: list[str], positions: dict[str, list[int]]) -> list[int]:
    """Places in ``own`` that a longest common subsequence with ``other`` covers."""
    common = set(positions).intersection(other)
    if not common:
        return []
    a = [i for i, x in enumerate(own) if x in common]
    b = [x for x in other if x in common]
    n, m = len(a), len(b)
    # equal ends need no table
    lo = 0
    while lo < n and lo < m and own[a[lo]] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and hi < m - lo and own[a[n - 1 - hi]] == b[m - 1 - hi]:
        hi += 1
    out = a[:lo] + a[n - hi :]
    x, y = a[lo : n - hi], b[lo : m - hi]
    if x and y:
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below, s = table[i], table[i + 1], own[x[i]]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if s == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if own[x[i]] == y[j]:
                out.append(x[i])
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
    return out


def fenced(lines: list[str]) -> list[bool]:
    """Which lines stand in fenced code, the fences included."""
    out, inside = [], False
    for line in lines:
        mark = line.lstrip().startswith(("```", "~~~"))
        out.append(inside or mark)
        if mark:
            inside = not inside
    return out


def own_links_only(line: str, host: str) -> bool:
    """Whether a line is nothing but links into the page's own host (or its fragments)."""
    links = _LINK.findall(line)
    if not links:
        return False
    if any(h and not h.startswith(("#", "/", "?")) and host_of(h)[0] != host for _, h in links):
        return False
    return not _BARS.sub("", _BULLET.sub("", _LINK.sub("", line)))


def furniture(lines: list[str], host: str, title: str | None, votes: list[int], enough: int) -> list[bool]:
    """Which lines are the site's furniture; ``votes``: the neighbours that share each line."""
    n = len(lines)
    code = fenced(lines)
    text = [x.strip() for x in lines]
    wanted = (title or "").strip().lower()
    title_at = next((i for i in range(n) if not code[i] and re.match(r"#\s+\S", text[i])), None)
    if title_at is not None and not wanted:
        wanted = text[title_at].lstrip("#").strip().lower()
    names = {x for x in (wanted, text[title_at].lstrip("#").strip().lower() if title_at is not None else "") if x}
    menu = {x.strip().lower() for t in text if "](" in t for x, h in _LINK.findall(t) if not foreign(t, host)}
    menu.update(t.lower() for t in text if t and len(t) < 40)
    bad = [False] * n
    i = 0
    while i < n:
        if not text[i]:
            i += 1
            continue
        j = i
        while j < n and text[j] and not (j > i and (j == title_at)):
            j += 1
        block = [k for k in range(i, j) if not code[k]]
        i = j
        if not block:
            continue
        alone_heading = len(block) == 1 and re.match(r"#{1,6}\s+\S", text[block[0]])
        if block[0] == title_at or (alone_heading and votes[block[0]] < max(enough, 4)):
            rest = block[1:] if block[0] == title_at else []
            for k in rest:
                bad[k] = votes[k] >= enough or own_links_only(lines[k], host)
            continue
        marks = []
        for k in block:
            s = text[k]
            crumb = len(s) < 300 and bool(_JOIN.search(s)) and "](" not in s and (any(s.lower().endswith(x) for x in names) or _JOIN.split(s)[0].strip().lower() in menu)
            # a line by itself that is neither sentence, list nor heading needs one neighbour only
            label = votes[k] > 0 and len(block) == 1 and len(s) < 120 and not _SENTENCE.search(s) and not _BULLET.match(s)
            marks.append(votes[k] >= enough or label or own_links_only(lines[k], host) or crumb or bool(_RULE.match(s)))
        glued = _HEAD.match(text[block[0]]) is not None and len(block) > 1 and all(len(text[k]) < 120 and not _SENTENCE.search(_BULLET.sub("", text[k])) and not foreign(lines[k], host) for k in block[1:])
        if glued:
            marks = [True] * len(block)
        elif any(marks):
            # what stands in one block with furniture and is no sentence belongs to it
            marks = [m or (len(text[k]) < 120 and not _SENTENCE.search(_BULLET.sub("", text[k])) and not foreign(lines[k], host)) for m, k in zip(marks, block)]
        for m, k in zip(marks, block):
            bad[k] = m
    return bad


def foreign(line: str, host: str) -> bool:
    return any(h and not h.startswith(("#", "/", "?")) and host_of(h)[0] != host for _, h in _LINK.findall(line))


def masked(line: str, host: str, title: str) -> str:
    """What a line is compared by; ``title``: the page's, in lower case."""
    if "](" in line and own_links_only(line, host):
        return f"{'-' if _BULLET.match(line) else ''}\x02{min(3, len(_LINK.findall(line)))}"
    s = normal(line)
    if title and s.endswith(title) and s != title and _JOIN.search(s) and not s.startswith("#"):
        return s[: -len(title)] + "\x01"
    return s


class _Html(HTMLParser):
    """The lines of an html page, in Markdown's form. Containers, sentences and headings begin a
    block; short lines that are no sentences stay in one block with what precedes them."""

    _SILENT = frozenset(("script", "style", "noscript", "template", "head", "svg"))
    _BREAK = frozenset("p div section article nav header footer main aside ul ol table tr blockquote form h1 h2 h3 h4 h5 h6 li pre br hr".split())
    _APART = _BREAK - {"li", "br", "tr", "p", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.line, self.silent, self.pre, self.links = [], [], 0, 0, []

    def _apart(self) -> None:
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def _end(self, apart: bool) -> None:
        if text := " ".join("".join(self.line).split()):
            told = not text.startswith("- ") and (len(text) >= 120 or _SENTENCE.search(text) is not None)
            if told or text.startswith("#"):
                self._apart()
            self.lines.append(text)
            if told:
                self._apart()
        self.line = []
        if apart:
            self._apart()

    def handle_starttag(self, tag, attrs):
        if tag in self._SILENT:
            self.silent += 1
        elif self.silent:
            return
        elif tag in self._BREAK:
            self._end(tag in self._APART)
            if tag == "pre":
                self.pre += 1
                self.lines.append("```")
            elif tag == "li":
                self.line = ["- "]
            elif tag[0] == "h" and tag[1:].isdigit():
                self.line = ["#" * int(tag[1]) + " "]
            elif tag == "hr":
                self.lines += ["---", ""]
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.line.append("[")
        elif tag == "code" and not self.pre:
            self.line.append("`")

    def handle_endtag(self, tag):
        if tag in self._SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "pre" and self.pre:
            self.lines += ["".join(self.line).strip("\n"), "```", ""]
            self.line, self.pre = [], self.pre - 1
        elif tag in self._BREAK:
            self._end(tag in self._APART)
        elif tag == "a" and self.links:
            self.line.append(f"]({self.links.pop()})")
        elif tag == "code" and not self.pre:
            self.line.append("`")

    def handle_data(self, data):
        if not self.silent:
            self.line.append(data)


def html_lines(html: str) -> str:
    """An html page as text in Markdown's form; scripts, styles and the head are left out."""
    parser = _Html()
    parser.feed(html)
    parser.close()
    parser._end(False)
    return "\n".join(parser.lines).strip("\n")


class _Page:
    __slots__ = ("id", "host", "title", "lines", "keys", "places", "heading", "long")

    def __init__(self, page_id: int, host: str, title: str | None, text: str):
        self.id, self.host, self.title = page_id, host, title
        self.lines = text.replace("\r", "").split("\n")
        code = fenced(self.lines)
        wanted = (title or "").strip().lower()
        self.keys, self.places = [], []
        for i, line in enumerate(self.lines):
            if line.strip() and not code[i]:
                self.keys.append(masked(line, host, wanted))
                self.places.append(i)
        self.heading = next((self.lines[i].strip().lower() for i, k in zip(self.places, self.keys) if k.startswith("# ")), None)
        self.long = {k for k in self.keys if len(k) >= ARTICLE}

    def copy_of(self, other: _Page) -> bool:
        """Whether another page tells the same: equal headings, and half of the long lines."""
        return self.heading is not None and self.heading == other.heading and 2 * len(self.long & other.long) >= min(len(self.long), len(other.long))

    def judge(self, neighbours: list[_Page]) -> tuple[list[bool], list[int]]:
        """(whether each line is furniture, the neighbours that share it)."""
        votes = [0] * len(self.lines)
        where: dict[str, list[int]] = {}
        for i, k in enumerate(self.keys):
            where.setdefault(k, []).append(i)
        compared = 0
        for o in neighbours:
            if o.id == self.id or self.copy_of(o):
                continue
            compared += 1
            for at in shared(self.keys, o.keys, where):
                votes[self.places[at]] += 1
        return furniture(self.lines, self.host, self.title, votes, 2 if compared >= 5 else 1), votes

    def body(self, bad: list[bool]) -> str:
        """The lines that are kept, with one blank line where some were, and code as it stands."""
        out: list[str] = []
        code = fenced(self.lines)
        for line, drop, inside in zip(self.lines, bad, code):
            if inside or (line.strip() and not drop):
                out.append(line)
            elif out and out[-1].strip():
                out.append("")
        while out and not out[-1].strip():
            out.pop()
        return "\n".join(out)


#: Characters from which a line counts as part of the article where pages are told apart.
ARTICLE = 80


def _base(pages: DataFrame, html: bool) -> DataFrame:
    """(page_id, host, path, title, text, key) of the pages with text; key: equal for equal articles."""
    host = F.coalesce(F.lower(F.regexp_extract(F.regexp_replace("final_url", "^([^/]*//)[^/@]*@", "$1"), r"^[^/]*//([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("final_url", r"^[^/]*//[^/?#]*([^?#]*)", 1), F.lit(""))
    text = F.col("markdown")
    if html:

        @F.pandas_udf("string")
        def made(views: pd.Series) -> pd.Series:
            return views.map(lambda v: html_lines(v) if isinstance(v, str) else None)

        blank = ~F.coalesce(F.col("markdown").rlike(r"\S"), F.lit(False))
        text = F.when(blank, made(F.when(blank, F.col("html")))).otherwise(text)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("title").cast("string").alias("title"), text.alias("text"))
    rows = rows.where(F.col("page_id").isNotNull() & F.col("text").rlike(r"\S"))
    long = F.filter(F.split(F.regexp_replace(F.lower("text"), "\r", ""), "\n"), lambda x: F.length(F.trim(x)) >= ARTICLE)
    heading = F.regexp_extract(F.lower("text"), r"(?m)^[ \t]{0,3}#[ \t]+(.*)$", 1)
    return rows.withColumn("key", F.when(F.size(long) > 0, F.xxhash64(heading, long)).otherwise(F.xxhash64(F.lit("alone"), "page_id")))


def _targets(base: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(page_id, key, target, at, kind, own) and the number of targets: where each page is needed.

    Narrow rows are sorted by host and path into ranges, the targets. Runs of pages with equal keys
    are numbered throughout. The first page of a run comes ``window`` runs ahead of its place
    (kind 0), to the ranges around too; the others of a run come at its place (kind 1).
    """
    spark = base.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = base.groupBy("page_id").agg(F.min(F.struct("host", "path", "key")).alias("r")).select("page_id", "r.*")
    ordered = cut(narrow.repartitionByRange(n, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id"))
    ordered = ordered.select("page_id", "host", "key", F.spark_partition_id().alias("part"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        runs = 0
        for b in batches:
            if not len(b):
                continue
            new = (b["host"] != b["host"].shift()) | (b["key"] != b["key"].shift())
            if first is None:
                first = (b["host"].iat[0], b["key"].iat[0], int(b["part"].iat[0]))
            else:
                new.iat[0] = (b["host"].iat[0], b["key"].iat[0]) != last
            runs += int(new.sum())
            last = (b["host"].iat[-1], b["key"].iat[-1])
        if first is not None:
            yield pd.DataFrame([(first[2], first[0], first[1], last[0], last[1], runs)], columns=["part", "first_host", "first_key", "last_host", "last_key", "runs"])

    # one row a range
    summary = sorted(ordered.mapInPandas(ends, "part int, first_host string, first_key long, last_host string, last_key long, runs long").collect(), key=lambda r: r["part"])
    low, high, hosts, parts, joined = [], [], [], [], []
    count, before = 0, None
    for r in summary:
        follows = before == (r["first_host"], r["first_key"])
        low.append(count - follows)
        count += r["runs"] - follows
        high.append(count - 1)
        hosts.append((r["first_host"], r["last_host"]))
        parts.append(r["part"])
        joined.append(follows)
        before = (r["last_host"], r["last_key"])
    place = {p: k for k, p in enumerate(parts)}

    def place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, run, k = None, 0, 0
        for b in batches:
            out = []
            for i, h, key, part in zip(b["page_id"], b["host"], b["key"], b["part"]):
                if last is None:
                    k = place[part]
                    run, fresh = low[k], not joined[k]
                else:
                    fresh = last != (h, key)
                    run += fresh
                last = (h, key)
                if not fresh:
                    out.append((i, key, part, run, 1, True))
                    continue
                for t in range(bisect_left(high, run - window), bisect_right(low, run + window)):
                    if t == k or hosts[t][0] <= h <= hosts[t][1]:
                        out.append((i, key, parts[t], run - window, 0, t == k))
            yield pd.DataFrame(out, columns=["page_id", "key", "target", "at", "kind", "own"])

    return ordered.mapInPandas(place_rows, "page_id long, key long, target int, at long, kind int, own boolean"), n


def _judged(pages: DataFrame, window: int, html: bool, emit, schema: str) -> DataFrame:
    """``emit(page, furniture, votes)`` of each page, a list of rows in ``schema``."""
    base = _base(pages, html)
    targets, n = _targets(base, window)
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: deque[tuple[int, _Page]] = deque()
        waiting: deque[tuple[int, _Page]] = deque()
        out: list[tuple] = []
        target = last = None

        def settle(page: _Page, at: int) -> None:
            out.extend(emit(page, *page.judge([o for r, o in near if abs(r - at) <= window and r != at and o.host == page.host])))

        def advance(to: int | None) -> None:
            """Judge the first pages of the runs up to ``to``, which all neighbours have arrived for."""
            while waiting and (to is None or waiting[0][0] <= to):
                at, page = waiting.popleft()
                while near and near[0][0] < at - window:
                    near.popleft()
                settle(page, at)

        for b in batches:
            for t, at, kind, i, own, h, n_, x in zip(b["target"], b["at"], b["kind"], b["page_id"], b["own"], b["host"], b["title"], b["text"]):
                if (t, i, kind) == last:
                    continue
                if t != target:
                    advance(None)
                    near.clear()
                    target = t
                last = (t, i, kind)
                advance(at if kind else at - 1)
                page = _Page(i, h, n_ if isinstance(n_, str) else None, x)
                if kind:
                    settle(page, at)
                else:
                    near.append((at + window, page))
                    if own:
                        waiting.append((at + window, page))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        advance(None)
        yield pd.DataFrame(out, columns=columns)

    placed = base.join(targets, ["page_id", "key"]).repartitionById(n, F.col("target")).sortWithinPartitions("target", "at", "kind", "page_id")
    return placed.select("target", "at", "kind", "page_id", "own", "host", "title", "text").mapInPandas(run, schema)


def differences(pages: DataFrame, window: int = 10, html: bool = False) -> DataFrame:
    """(page_id, line_no, furniture, votes) of each non-blank line; ``window`` neighbours on either side."""

    def lines(page: _Page, bad: list[bool], votes: list[int]) -> list[tuple]:
        return [(page.id, i + 1, bad[i], votes[i]) for i, line in enumerate(page.lines) if line.strip()]

    return _judged(pages, window, html, lines, "page_id long, line_no long, furniture boolean, votes int")


def main_body(pages: DataFrame, window: int = 10) -> DataFrame:
    """(page_id, body): each page without the furniture, from its html where it has no Markdown; null without either."""
    made = _judged(pages, window, True, lambda page, bad, _: [(page.id, page.body(bad))], "page_id long, body string")
    return pages.select(F.col("page_id").cast("long")).where("page_id is not null").distinct().join(made, "page_id", "left")


def found(pages: DataFrame, bad_pages: DataFrame) -> DataFrame:
    """Furniture lines of the pages that hold an article; bad_pages: (page_id) of the others."""
    return differences(pages).where("furniture").join(bad_pages, "page_id", "left_anti").select("page_id", "line_no").distinct()
