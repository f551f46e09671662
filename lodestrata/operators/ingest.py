"""Learning sources: a repository or a site is scanned, chunked, embedded and put in the store, with its manifest.

Everything between the listing of files (or the fetching of pages) and the store is one plan: rows
are numbered, chunked and embedded in tasks, and written once a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import redaction as X
from lodestrata.functions import text as T
from lodestrata.functions.embedding import EmbeddingProvider
from lodestrata.progress import Progress
from lodestrata.session import cut, numbered
from lodestrata.sources import files, webpages

from . import chunking
from .crawl import crawl
from .store import CHUNKS, DOCUMENTS, Store, index_state, rebuild


class NothingLearned(RuntimeError):
    """No page or file of a source could be taken; ``failures`` says why."""

    def __init__(self, message: str, failures: list[dict]):
        super().__init__(message)
        self.failures = failures


@dataclass
class Learned:
    """What one source gave."""

    source_key: str
    documents: int
    chunks: int
    skipped: dict[str, int] = field(default_factory=dict)
    failures: list[dict] = field(default_factory=list)
    attempts: dict[str, int] = field(default_factory=dict)
    pages: int = 0


@dataclass
class Learner:
    """A store with all that learning needs. ``now`` gives the time as text."""

    spark: SparkSession
    store: Store
    embedder: EmbeddingProvider
    now: Callable[[], str]
    size: int = 1200
    overlap: int = 150
    most_bytes: int = files.MOST_BYTES
    cache: str = ".lodestrata/repositories"
    pages: webpages.PageSource | None = None
    retries: int = 3
    delay_seconds: float = 0
    progress: Progress = field(default_factory=Progress)

    def rows(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents, chunks) as stored, of rows without ids; documents that give no chunk are left out.

        Ids go on from the last one used, in order of source and path.
        """
        step = self.progress.start("chunk and embed")
        begin = int(self.store.metadata().get("next_document_id", "1"))
        named = numbered(documents, ["source_key", "path"], begin)
        made = chunking.chunk(named, self.size, self.overlap).join(named.select(F.col("id").alias("document_id"), "source_key"), "document_id")
        order = numbered(made, ["document_id", "chunk_index"], int(self.store.metadata().get("next_chunk_id", "1")))
        placed = cut(order.withColumns({"created_at": F.lit(self.now()), "embedding": self.embedder.embed(F.col("content"))}).select([c.split()[0] for c in CHUNKS.split(", ")]))
        kept = named.join(placed.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
        last = placed.agg(F.max("document_id").alias("d"), F.max("id").alias("c")).first()
        if last["d"] is not None:
            self.store.set_metadata("next_document_id", str(last["d"] + 1))
            self.store.set_metadata("next_chunk_id", str(last["c"] + 1))
        documents = cut(kept.select([c.split()[0] for c in DOCUMENTS.split(", ")]))
        self.progress.add(step, documents.count())
        self.progress.stop(step)
        return documents, placed

    def put(self, source_key: str, documents: DataFrame) -> tuple[int, int]:
        rows, chunks = self.rows(documents)
        return self.store.replace_source(source_key, rows, chunks, self.now())

    def learn_git(self, source: str, record: bool = True, timeout_ms: int = 30_000) -> Learned:
        """Learn the tracked files of a repository. Its old rows are replaced even if no file can be read; then it fails."""
        at = files.resolve_git(source, self.cache, timeout_ms)
        scanned, failures = files.read_repository(self.spark, at.root, self.most_bytes, timeout_ms)
        scanned = cut(scanned)
        skipped = {r["reason"]: r["n"] for r in scanned.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).collect()}  # one row a reason
        text = F.col("text")
        locator = F.lit(at.url) if at.url else F.concat(F.lit(f"{at.root}/"), "path")
        rows = scanned.where("reason is null").select(
            F.lit(at.key).alias("source_key"), F.lit(at.kind).alias("source_kind"), locator.alias("source_locator"), F.lit(None).cast("string").alias("canonical_locator"), "path", "language",
            F.element_at(F.split("path", "/"), -1).alias("title"), T.content_hash(text).alias("content_hash"), text.alias("content"), F.lit(self.now()).alias("created_at"),
        )
        documents, chunks = self.put(at.key, rows)
        if record:
            self.store.record_manifest(at.key, at.kind, "git", at.url or at.root, {"kind": "git", "source": source}, self.now(), source)
        if not documents and failures:
            raise NothingLearned(f"no file of {at.key} could be read", failures)
        return Learned(at.key, documents, chunks, skipped, failures)

    def learn_web(self, source: str, crawling: bool = False, max_pages: int = 25, max_depth: int = 2, mode: str = "auto", record: bool = True) -> Learned:
        """Learn a page, or a site from its root. Without any page or chunk it fails, and old rows stay."""
        if self.pages is None:
            raise ValueError("no page source is set")
        self.pages.check()
        step = self.progress.start("fetch pages", max_pages if crawling else 1)
        if isinstance(self.pages, webpages.ServicePages) and crawling:
            found, failed = self.pages.crawl(self.spark, source, max_pages, max_depth, mode)
            found = found.withColumns({"identity": X.page_identity(F.col("url")), "attempts": F.lit(1)})
        else:
            found, failed = crawl(self.spark, source, self.pages, max_pages=max_pages if crawling else 1, max_depth=max_depth if crawling else 1, mode=mode, retries=self.retries, delay_seconds=self.delay_seconds)
        found = cut(found.dropDuplicates(["identity"]))
        # as many as the crawl's limit
        failures = [r.asDict() for r in failed.collect()]
        attempts = {r["identity"]: r["attempts"] for r in found.select("identity", "attempts").collect()}
        self.progress.add(step, len(attempts))
        self.progress.stop(step)
        if not attempts:
            raise NothingLearned(f"no page of {X.redact_text_literal(source)} could be fetched", failures)
        key = X.redact_url(source, drop_fragment=True) or source
        rows = found.select(
            F.lit(key).alias("source_key"), F.lit("web").alias("source_kind"), F.col("identity").alias("source_locator"), F.lit(None).cast("string").alias("canonical_locator"), F.col("identity").alias("path"),
            F.lit("markdown").alias("language"), "title", T.content_hash(F.col("markdown")).alias("content_hash"), F.col("markdown").alias("content"), F.lit(self.now()).alias("created_at"),
        )
        named, chunks = self.rows(rows)
        given = {r["path"] for r in named.select("path").collect()}  # as many as the crawl's limit
        if crawling:
            failures += [{"url": u, "stage": "chunk", "reason": "no_chunks", "error": "the page gave no chunk", "attempts": n} for u, n in sorted(attempts.items()) if u not in given]
        if not given:
            raise NothingLearned(f"no page of {key} gave a chunk", failures)
        documents, written = self.store.replace_source(key, named, chunks, self.now())
        if record:
            payload = {"kind": "web", "source": key, "crawl": crawling, "max_pages": max_pages, "max_depth": max_depth, "mode": mode}
            self.store.record_manifest(key, "web", self.pages.id, key, payload, self.now(), source)
        return Learned(key, documents, written, {}, failures, attempts, len(attempts))

    def reingest(self, manifest: dict) -> Learned:
        """Learn a recorded source again, as its manifest says."""
        payload = json.loads(manifest["reingest_payload_json"])
        if payload.get("kind") == "git":
            return self.learn_git(payload["source"])
        if payload.get("kind") == "web":
            return self.learn_web(payload["source"], payload["crawl"], payload["max_pages"], payload["max_depth"], payload["mode"])
        raise ValueError(f"the manifest of {manifest['source_key']} says no known kind")

    def rebuild(self, **options) -> dict:
        return rebuild(self.store, self.reingest, self.embedder.fingerprint(), self.now, **options)

    def ensure(self) -> dict:
        """Bring the index up to date before it is used: {rebuilt, reason}. Without sources it is made empty;
        else all are learned again, once each, and the first failure is an error."""
        wanted = self.embedder.fingerprint()
        failed = self.store.manifests.where("last_rebuild_status = 'failed'").count()
        state = index_state(self.store.exists(), failed, self.store.fingerprint(), wanted.json())
        if not state["needs_rebuild"]:
            return {"rebuilt": False, "reason": None}
        if self.store.manifests.isEmpty():
            self.store.initialise()
            self.store.set_fingerprint(wanted)
            return {"rebuilt": True, "reason": state["reason"]}
        done = self.rebuild(retry=0, fail_fast=True)
        if done["failed"]:
            raise RuntimeError("rebuilding failed: " + "; ".join(f"{k} ({done['errors'][k]})" for k in done["failed"]))
        return {"rebuilt": True, "reason": state["reason"]}
