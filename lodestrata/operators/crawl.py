"""Bounded breadth-first traversal of a link graph, and the crawl of a site by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import redaction as X
from lodestrata.session import cut
from lodestrata.sources import webpages


def breadth_first(edges: DataFrame, roots: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(page, depth, position) of the pages reached; edges: (src, dst, position), roots: (page).

    Depth 0 is a root; pages of depth max_depth - 1 aren't expanded. The cap keeps the first pages
    in order of depth, of the page that links to them and of the link's position there; only with a
    cap are positions numbered, else they are null. Each level is one join with the edges, minus the
    levels before it, which are kept as they are.
    """
    edges = edges.select("src", "dst", F.col("position").alias("at"))
    start = roots.select("page").distinct()
    if max_pages is not None:
        start = start.orderBy("page").limit(max_pages)
    none = F.lit(None).cast("long").alias("position")
    position = F.row_number().over(Window.orderBy("page")).cast("long").alias("position") if max_pages is not None else none  # at most the cap
    levels = [cut(start.select("page", F.lit(0).alias("depth"), position))]
    reached = levels[0].count() if max_pages is not None else 0
    for depth in range(1, max_depth):
        if max_pages is not None and reached >= max_pages:
            break
        seen = reduce(DataFrame.unionByName, levels).select("page")
        step = levels[-1].join(edges, levels[-1]["page"] == edges["src"]).select(F.col("dst").alias("page"), F.col("position").alias("parent"), "at")
        if max_pages is None:
            found = step.select("page").distinct().join(seen, "page", "left_anti").select("page", F.lit(depth).alias("depth"), none)
        else:
            first = step.groupBy("page").agg(F.min(F.struct("parent", "at")).alias("o")).join(seen, "page", "left_anti")
            kept = first.select("page", "o.*").orderBy("parent", "at", "page").limit(max_pages - reached)
            number = F.row_number().over(Window.orderBy("parent", "at", "page")) + reached  # at most the cap
            found = kept.select("page", F.lit(depth).alias("depth"), number.cast("long").alias("position"))
        levels.append(cut(found))
        new = levels[-1].count()
        if not new:
            break
        reached += new
    return reduce(DataFrame.unionByName, levels)


def wanted(url: Column, root: str) -> Column:
    """Whether a crawl from ``root`` takes a URL: its origin, its scope, and no asset or noise."""
    return X.in_scope(url, root) & ~X.excluded_by_default(url)


def crawl(spark: SparkSession, root: str, source: webpages.PageSource, *, max_pages: int = 25, max_depth: int = 2, mode: str = "auto", retries: int = 3, delay_seconds: float = 0, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of a site, breadth first from ``root``.

    pages: (url, identity, title, markdown, depth, position, attempts); failures: (url, stage, reason,
    error, attempts, depth). A page's identity is its redacted URL without fragment: URLs that differ in
    secrets only are fetched once. Failed pages don't count towards ``max_pages``, so each level is
    fetched in slices of what is still missing, in order of discovery; a page of depth
    max_depth - 1 isn't expanded. ``scope``: the URL whose folder the crawl stays in, by default the root.
    """
    normal, within = webpages.normal_url(F.lit(root)), scope or root
    frontier = cut(spark.range(1).select(normal.alias("url"), X.page_identity(normal).alias("identity"), F.lit(1).cast("long").alias("position")).where(wanted(F.col("url"), within)))
    queued = [frontier.select("identity")]
    pages: list[DataFrame] = []
    failures: list[DataFrame] = []
    got = 0
    for depth in range(max(1, max_depth)):
        level: list[DataFrame] = []
        rest, left = frontier, frontier.count()
        while left and got < max_pages:
            n = min(left, max_pages - got)
            piece = cut(rest.orderBy("position").limit(n))
            last = piece.agg(F.max("position")).first()[0]
            fetched = webpages.fetch_pages(piece.repartition("url"), source, mode, retries, delay_seconds)
            done = cut(fetched.join(piece, "url"))
            good = done.where("record is not null")
            fields = webpages.page_fields(good.select(F.col("url").alias("asked"), "record")).withColumnRenamed("url", "final")
            number = (F.row_number().over(Window.orderBy("position")) + got).cast("long")  # at most max_pages
            named = good.select("url", "position", "attempts").join(fields, F.col("url") == F.col("asked"))
            taken = cut(named.select(F.col("final").alias("url"), X.page_identity(F.col("final")).alias("identity"), "title", "markdown", "links", F.lit(depth).alias("depth"), number.alias("number"), "attempts"))
            failures.append(done.where("record is null").select("identity", F.lit("fetch").alias("stage"), X.failure_reason(F.col("error")).alias("reason"), "error", "attempts", F.lit(depth).alias("depth")).withColumnRenamed("identity", "url"))
            level.append(taken)
            got += taken.count()
            rest, left = rest.where(F.col("position") > last), left - n
        pages += level
        if not level or got >= max_pages or depth + 1 >= max_depth:
            break
        links = reduce(DataFrame.unionByName, level).select("number", F.posexplode("links").alias("at", "link")).withColumn("url", webpages.normal_url(F.col("link")))
        fresh = links.where(wanted(F.col("url"), within)).withColumn("identity", X.page_identity(F.col("url"))).groupBy("identity").agg(F.min_by(F.struct("url", "number", "at"), F.struct("number", "at")).alias("o"))
        fresh = fresh.join(reduce(DataFrame.unionByName, queued), "identity", "left_anti").select("identity", "o.*")
        # every page has a place after all of the levels before it: the page that links to it, then the link
        frontier = cut(fresh.select("url", "identity", (F.col("number") * 1_000_000 + F.col("at")).alias("position")))
        queued.append(frontier.select("identity"))
    empty = spark.createDataFrame([], "url string, stage string, reason string, error string, attempts int, depth int")
    no_page = spark.createDataFrame([], "url string, identity string, title string, markdown string, links array<string>, depth int, number long, attempts int")
    found = reduce(DataFrame.unionByName, pages, no_page).withColumnRenamed("number", "position").drop("links")
    return found, reduce(DataFrame.unionByName, failures, empty)
