"""Web pages from crawlers: their replies as Column expressions, fetch modes, paged jobs, search results.

A page source is any object with ``fetch(url, mode) -> dict`` (a crawler's record) that raises on
failure. Fetching happens in tasks (``mapInPandas``), so the pages of a level are fetched in
parallel; the records are parsed by expressions. No network is needed for recorded pages.
"""

from __future__ import annotations

import json
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import redaction as X

MODES = ("auto", "get", "fetch")
_LINKS = "array<string>"


# --- replies --------------------------------------------------------------------------------------


def json_from_output(text: str):
    """The JSON value of a program's output: all of it, else from the first opening to the last closing mark."""
    body = text.strip()
    if not body:
        raise ValueError("the crawler gave no json")
    try:
        return json.loads(body)
    except ValueError:
        starts = [k for k in (body.find("{"), body.find("[")) if k >= 0]
        end = max(body.rfind("}"), body.rfind("]"))
        if starts and end > min(starts):
            try:
                return json.loads(body[min(starts) : end + 1])
            except ValueError:
                pass
    raise ValueError("the crawler's output is no json: " + body[:2000])


def as_records(value) -> list:
    return value if isinstance(value, list) else [value]


def _text(record: Column, path: str) -> Column:
    """A string field of a JSON record; null where it is missing or no string."""
    field = F.try_variant_get(F.try_parse_json(record), path, "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), path, "variant"))
    return F.when(kind == "STRING", field)


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def markdown_of(record: Column) -> Column:
    """Markdown itself, else its raw form, else its fitted form, else the record's raw form, else empty."""
    return F.coalesce(_text(record, "$.markdown"), _text(record, "$.markdown.raw_markdown"), _text(record, "$.markdown.fit_markdown"), _text(record, "$.raw_markdown"), F.lit(""))


def url_of(record: Column, asked: Column) -> Column:
    return F.coalesce(_filled(_text(record, "$.url")), _filled(_text(record, "$.metadata.url")), asked)


def title_of(record: Column, otherwise: Column) -> Column:
    return F.coalesce(F.trim(_filled(_text(record, "$.metadata.title"))), F.trim(_filled(_text(record, "$.title"))), otherwise)


def links_of(record: Column, base: Column) -> Column:
    """Absolute links, internal ones first; each a string or an object with ``href``."""

    def side(name: str) -> Column:
        items = F.from_json(F.get_json_object(record, f"$.links.{name}"), "array<string>")
        return F.transform(F.coalesce(items, F.array().cast(_LINKS)), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.href")).otherwise(x))

    return absolute(F.concat(side("internal"), side("external")), base)


def absolute(links: Column, base: Column) -> Column:
    """Links resolved against the page, without fragments; what isn't http is left out."""

    @F.pandas_udf(_LINKS)
    def run(many: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([[u for x in (xs if xs is not None else []) if x and (u := X.absolute_url(x, b or ""))] for xs, b in zip(many, bases)])

    return run(links, base)


def normal_url(url: Column) -> Column:
    """Without fragment, host in lower case, a path at least."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    return F.when(head == "", bare).otherwise(F.concat(head, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def page_fields(records: DataFrame) -> DataFrame:
    """(asked, url, title, markdown, links) of raw records (asked, record)."""
    r = F.col("record")
    named = records.withColumn("url", url_of(r, F.col("asked")))
    return named.select("asked", normal_url(F.col("url")).alias("url"), title_of(r, F.col("url")).alias("title"), markdown_of(r).alias("markdown"), links_of(r, F.col("url")).alias("links"))


def record_failure(status: Column, http: Column) -> tuple[Column, Column]:
    """(reason, error) of a paged record that holds no page."""
    s = F.coalesce(status, F.lit("errored"))
    said = (
        F.when(s == "disallowed", "crawl record disallowed by robots.txt").when(s == "skipped", "crawl record skipped by crawl filters").when(s == "cancelled", "crawl record cancelled")
        .when((s == "errored") & http.isNotNull(), F.concat(F.lit("crawl record errored (http "), http.cast("string"), F.lit(")"))).when(s == "errored", "crawl record errored")
        .otherwise(F.concat(F.lit("crawl record status="), s))
    )
    return s, said


def first_seen(pages: DataFrame, url: str = "url", position: str = "position", most: int | None = None) -> DataFrame:
    """The first page of each URL, in order of position; at most ``most`` of them."""
    first = pages.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(position))).where("_n = 1").drop("_n")
    return first if most is None else first.orderBy(position).limit(most)


def choose_attempt(attempts: DataFrame, least_chars: int = 200) -> DataFrame:
    """The attempt that counts for each URL in automatic mode; attempts: (url, mode, markdown, error).

    A get with enough text, else a fetch with any, else a get with any, else the get's error.
    """
    n = F.length(F.coalesce("markdown", F.lit("")))
    got, fetched = F.col("mode") == "get", F.col("mode") == "fetch"
    order = F.when(got & (n >= least_chars), 0).when(fetched & (n >= 1), 1).when(got & (n >= 1), 2).when(got, 3).otherwise(4)
    return attempts.withColumn("_o", order).groupBy("url").agg(F.min_by(F.struct("mode", "markdown", "error", "_o"), "_o").alias("r")).select(
        "url", "r.mode", F.when(F.col("r._o") < 3, F.col("r.markdown")).alias("markdown"), F.when(F.col("r._o") >= 3, F.coalesce("r.error", F.lit("content too short"))).alias("error")
    )


# --- page sources ---------------------------------------------------------------------------------


class PageSource(Protocol):
    id: str

    def check(self) -> None: ...

    def fetch(self, url: str, mode: str) -> dict: ...


class RecordedPages:
    """Records by URL; what isn't there, or holds ``error``, fails. ``fails`` counts failures before a success."""

    id = "recorded"

    def __init__(self, records: dict[str, dict], fails: dict[str, int] | None = None):
        self.records, self.fails, self.calls = records, dict(fails or {}), []

    def check(self) -> None:
        pass

    def fetch(self, url: str, mode: str) -> dict:
        self.calls.append(url)
        if self.fails.get(url, 0) > 0:
            self.fails[url] -= 1
            raise RuntimeError(f"network: {url} failed")
        record = self.records.get(url)
        if record is None or "error" in record:
            raise RuntimeError(record["error"] if record else f"no page at {url}")
        return record


class CommandPages:
    """A crawler program that prints records as JSON; it gets its settings as a file, and more time than the page."""

    id = "command"

    def __init__(self, command: str, page_timeout_ms: dict[str, int] | None = None, grace_ms: int = 1000):
        self.command, self.timeouts, self.grace = command, page_timeout_ms or {"get": 30_000, "fetch": 60_000}, grace_ms

    def check(self) -> None:
        try:
            done = subprocess.run([self.command, "--help"], capture_output=True, timeout=20, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise RuntimeError(f"the crawler {self.command} can't be run") from e
        if done.returncode:
            raise RuntimeError(f"the crawler {self.command} ended with {done.returncode}")

    def fetch(self, url: str, mode: str) -> dict:
        with tempfile.TemporaryDirectory() as folder:  # of one call, in the task that makes it
            settings = Path(folder, "crawler.json")
            settings.write_text(json.dumps({"page_timeout": self.timeouts[mode], "wait_until": "networkidle" if mode == "fetch" else "domcontentloaded"}))
            try:
                done = subprocess.run([self.command, "crawl", url, "-o", "json", "-C", str(settings)], capture_output=True, text=True, timeout=(self.timeouts[mode] + self.grace) / 1000, check=False)
            except subprocess.TimeoutExpired as e:
                raise RuntimeError(f"the crawler timed out at {url}") from e
        if done.returncode:
            raise RuntimeError(f"the crawler ended with {done.returncode}: {done.stderr.strip()[:400]}")
        found = as_records(json_from_output(done.stdout))
        if not found or not isinstance(found[0], dict):
            raise RuntimeError("the crawler gave no record")
        return found[0]


class ServicePages:
    """A crawl service: ``call(path, body) -> reply``, replies as {success, result}."""

    id = "service"

    def __init__(self, call: Callable[[str, dict], dict], poll_ms: int = 10_000, polls: int = 60, sleep: Callable[[float], None] = lambda ms: time.sleep(ms / 1000)):
        self.call, self.poll_ms, self.polls, self.sleep = call, poll_ms, polls, sleep

    def check(self) -> None:
        pass

    def _result(self, path: str, body: dict):
        reply = self.call(path, body)
        if not reply.get("success") or "result" not in reply:
            raise RuntimeError(f"the crawl service refused {path}: {json.dumps(reply)[:400]}")
        return reply["result"]

    def fetch(self, url: str, mode: str) -> dict:
        body = {"url": url} | ({"gotoOptions": {"waitUntil": "networkidle2"}} if mode == "fetch" else {})
        return {"url": url, "markdown": self._result("/markdown", body)}

    def records(self, job: str, most: int) -> list[dict]:
        """Records of a finished job, page by page, cut at ``most``."""
        out: list[dict] = []
        cursor = None
        while len(out) < most:
            body = {"limit": min(1000, most - len(out))} | ({"cursor": cursor} if cursor is not None else {})
            got = self._result(f"/crawl/{job}", body)
            out += got.get("records") or []
            cursor = got.get("cursor")
            if cursor is None:
                break
        return out[:most]

    def _once(self, url: str, most: int, depth: int, render: bool) -> list[dict]:
        job = self._result("/crawl", {"url": url, "limit": most, "depth": depth, "render": render})
        for _ in range(self.polls):
            state = self._result(f"/crawl/{job}", {"limit": 1}).get("status")
            if state not in ("running", "queued"):
                if state != "completed":
                    raise RuntimeError(f"crawl job {state}")
                return self.records(job, most)
            self.sleep(self.poll_ms)
        raise RuntimeError("crawl job timed out")

    def crawl(self, spark: SparkSession, url: str, most: int, depth: int, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
        """(pages, failures) of a whole crawl: without rendering first, with it where that gives no page."""
        renders = {"get": [False], "fetch": [True], "auto": [False, True]}[mode]
        for n, render in enumerate(renders):
            pages, failures = paged_records(spark, self._once(url, most, depth, render), url)
            if n + 1 == len(renders) or not pages.isEmpty():
                return pages, failures


def paged_records(spark: SparkSession, records: list[dict], root: str) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of a job's records, at most its limit: completed ones with text are pages, the first of each URL."""
    rows = [(n, json.dumps(r)) for n, r in enumerate(records)]
    df = spark.createDataFrame(rows, "position long, record string")
    r = F.col("record")
    status, http = _text(r, "$.status"), F.get_json_object(r, "$.metadata.status").cast("int")
    url = normal_url(F.coalesce(_filled(_text(r, "$.url")), _filled(_text(r, "$.metadata.url")), F.lit(root)))
    df = df.select("position", status.alias("status"), http.alias("http"), url.alias("url"), title_of(r, url).alias("title"), markdown_of(r).alias("markdown"))
    good = (F.col("status") == "completed") & (F.trim("markdown") != "")
    reason, error = record_failure(F.when(F.col("status") == "completed", "empty").otherwise(F.col("status")), F.col("http"))
    bad = df.where(~F.coalesce(good, F.lit(False))).select("url", F.lit("fetch").alias("stage"), reason.alias("reason"), error.alias("error"), F.lit(1).alias("attempts"))
    return first_seen(df.where(good)).select("position", "url", "title", "markdown"), bad


def fetch_pages(urls: DataFrame, source: PageSource, mode: str, retries: int, delay_seconds: float = 0, least_chars: int = 200, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, record, error, attempts) of each row of ``urls`` (url, ...), fetched in the tasks that hold them.

    A page is tried ``1 + retries`` times. In automatic mode a get needs ``least_chars`` of text, else
    a fetch is taken, else a get with any text.
    """
    if mode not in MODES:
        raise ValueError(mode)

    def one(url: str, kind: str, least: int) -> dict:
        record = source.fetch(url, kind)
        text = record.get("markdown")
        text = (text.get("raw_markdown") or text.get("fit_markdown") or "") if isinstance(text, dict) else text or record.get("raw_markdown") or ""
        if len(text) < least:
            raise RuntimeError(f"content too short ({len(text)} characters, {kind})")
        return record

    def by_mode(url: str) -> dict:
        if mode != "auto":
            return one(url, mode, 1)
        try:
            return one(url, "get", least_chars)
        except Exception as first:  # noqa: BLE001 - the first error is the one to report
            for kind in ("fetch", "get"):
                try:
                    return one(url, kind, 1)
                except Exception:  # noqa: BLE001
                    continue
            raise first from None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url in b["url"]:
                record = error = None
                for attempt in range(1, retries + 2):
                    try:
                        record, error = json.dumps(by_mode(url)), None
                        break
                    except Exception as e:  # noqa: BLE001 - a page's failure is a row
                        error = str(e)
                        if attempt <= retries and delay_seconds > 0:
                            sleep(delay_seconds)
                out.append((url, record, error, attempt))
            yield pd.DataFrame(out, columns=["url", "record", "error", "attempts"])

    return urls.select("url").mapInPandas(run, "url string, record string, error string, attempts int")


# --- public search and registries -----------------------------------------------------------------


def search_results(spark: SparkSession, reply: dict) -> DataFrame:
    """(rank, title, url, content, score) of a web search's reply; missing fields are empty."""
    rows = [(n, json.dumps(r)) for n, r in enumerate(reply.get("results") or [], 1)]
    r = F.col("r")
    return spark.createDataFrame(rows, "rank int, r string").select("rank", *[F.coalesce(F.get_json_object(r, f"$.{c}"), F.lit("")).alias(c) for c in ("title", "url", "content")], F.get_json_object(r, "$.score").cast("double").alias("score"))


_SOURCES: dict[str, Callable[..., PageSource]] = {"recorded": RecordedPages, "command": CommandPages, "service": ServicePages}


def page_source(name: str, *args, **settings) -> PageSource:
    """A page source by its name in the settings."""
    if name not in _SOURCES:
        raise ValueError(f"unknown page source {name}")
    return _SOURCES[name](*args, **settings)
