"""The index as a folder of Parquet tables: replace-by-source writes, manifests, state and reports."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.embedding import Fingerprint
from lodestrata.functions.redaction import redact_deep, redact_text_literal, redact_url
from lodestrata.functions.text import tokens
from lodestrata.session import Folder, cut

SCHEMA_VERSION = "4"
DOCUMENTS = "id long, source_key string, source_kind string, source_locator string, canonical_locator string, path string, language string, title string, content_hash string, content string, created_at string"
CHUNKS = "id long, document_id long, chunk_index int, section string, content string, token_estimate int, content_hash string, created_at string, embedding array<double>, source_key string"
MANIFESTS = (
    "source_key string, source_kind string, provider string, root_locator string, display_locator string, reingest_payload_json string, created_at string, updated_at string, last_ingested_at string, "
    "last_rebuild_status string, last_rebuild_error string, last_rebuild_attempts int, last_rebuild_at string, last_rebuild_success_at string"
)
_KEPT = ("created_at", "last_rebuild_status", "last_rebuild_error", "last_rebuild_attempts", "last_rebuild_at", "last_rebuild_success_at")


def upsert_manifests(manifests: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known sources keep their creation and rebuild state, the rest is refreshed; new ones start idle."""
    old, new = manifests.alias("o"), fresh.alias("n")
    joined = old.join(new, F.col("o.source_key") == F.col("n.source_key"), "full")
    start = {"last_rebuild_status": F.lit("idle"), "last_rebuild_attempts": F.lit(0)}

    def pick(c: str):
        if c == "source_key":
            return F.coalesce("n.source_key", "o.source_key")
        if c in _KEPT:
            first = F.col("n.created_at") if c == "created_at" else start.get(c, F.lit(None))
            return F.when(F.col("o.source_key").isNotNull(), F.col(f"o.{c}")).otherwise(first)
        return F.when(F.col("n.source_key").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).cast(manifests.schema[c].dataType).alias(c) for c in manifests.columns])


def replace_source(rows: DataFrame, source_key: str, fresh: DataFrame) -> DataFrame:
    """``rows`` with all rows of one source replaced."""
    return rows.where(F.col("source_key") != source_key).unionByName(fresh.where(F.col("source_key") == source_key))


def index_state(has_tables: bool, failed: int, stored: dict | None, wanted: dict) -> dict:
    """Whether a rebuild is needed, whether a full one, and why; the first reason holds."""
    differs = stored != wanted
    if not has_tables:
        return {"needs_rebuild": True, "full": True, "reason": "index bootstrap required"}
    if failed > 0:
        return {"needs_rebuild": True, "full": differs, "reason": "one or more source rebuilds failed"}
    if differs:
        return {"needs_rebuild": True, "full": True, "reason": "embedding fingerprint " + ("changed" if stored else "missing")}
    return {"needs_rebuild": False, "full": False, "reason": None}


class Conflict(RuntimeError):
    """Another writer changed the index meanwhile."""


#: Schemas of the stored tables; chunks carry their document's place, so that a retriever reads one table.
TABLES = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS + ", source_kind string, path string",
    "postings": "term string, chunk_id long, tf long, source_key string",
    "lengths": "chunk_id long, dl long, path string, source_key string",
}
_LIVE = "source_key string, batch string"


class Store:
    """An index in a folder of any file system that Spark writes to.

    A write puts the rows of its sources into a new batch of each table, then the list of live
    sources and the manifests into new folders, and at last one small file that names them: readers
    see all of a write or nothing, and a reader keeps the state it opened. A second writer that
    comes between is found by the file's number, and the write is tried again. Batches that no
    state names are removed by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def snapshot(self) -> dict:
        """The last state: its number, folders and metadata."""
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names("states") if n.endswith(".json") and n[0] != "."]
        if not numbers:
            return {"number": 0, "live": None, "manifests": None, "metadata": {}}
        return json.loads(self.folder.read(f"states/{max(numbers):012d}.json"))

    def _commit(self, change: Callable[[dict], dict], attempts: int = 3) -> dict:
        """Put a state after the last one; ``change`` makes it from that and may write tables."""
        for attempt in range(attempts):
            last = self.snapshot()
            state = change(last) | {"number": last["number"] + 1}
            if self.folder.create(f"states/{state['number']:012d}.json", json.dumps(state, sort_keys=True)):
                return state
            time.sleep(0.2 * (attempt + 1))
        raise Conflict(self.folder.path)

    def _new(self, kind: str, df: DataFrame) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder.path}/{name}")
        return name

    def _table(self, name: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder.path}/{name}") if name else self.spark.createDataFrame([], schema)

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """The live rows of a table."""
        state = state or self.snapshot()
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        if not state["live"] or not self.folder.exists(f"data/{name}"):
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(f"{TABLES[name]}, batch string").parquet(f"{self.folder.path}/data/{name}")
        # partitions of batches that aren't live are pruned by the join
        return rows.join(self._table(state["live"], _LIVE), ["batch", "source_key"]).select(*columns)

    documents = property(lambda self: self.read("documents"))
    chunks = property(lambda self: self.read("chunks"))
    postings = property(lambda self: self.read("postings"))
    lengths = property(lambda self: self.read("lengths"))
    manifests = property(lambda self: self._table(self.snapshot()["manifests"], MANIFESTS))

    @property
    def searchable(self) -> DataFrame:
        """Chunks as the retrievers read them."""
        return self.chunks.withColumnRenamed("id", "chunk_id")

    def exists(self) -> bool:
        return self.snapshot()["live"] is not None

    def initialise(self) -> None:
        """Empty tables, where there are none."""
        if not self.exists():
            self._commit(lambda last: last | {"live": self._new("live", self.spark.createDataFrame([], _LIVE)), "metadata": last["metadata"] | {"schema_version": SCHEMA_VERSION}})

    def reset(self) -> None:
        """Empty tables; manifests and metadata stay."""
        self._commit(lambda last: last | {"live": self._new("live", self.spark.createDataFrame([], _LIVE))})

    def metadata(self) -> dict[str, str]:
        return self.snapshot()["metadata"]

    def set_metadata(self, key: str, value: str | None) -> None:
        self._commit(lambda last: last | {"metadata": {k: v for k, v in (last["metadata"] | {key: value}).items() if v is not None}})

    def replace_sources(self, keys: DataFrame, documents: DataFrame, chunks: DataFrame, now: str) -> None:
        """Replace all documents and chunks of the sources in ``keys`` (source_key); those without rows are removed.

        One write a table, however many sources there are. A path that stands twice in a source is an error.
        """
        keys = cut(keys.select("source_key").distinct())
        taken = documents.join(keys, "source_key", "left_semi")
        twice = taken.groupBy("source_key", "path").count().where("count > 1").select("source_key", "path").first()
        if twice:
            raise ValueError(f"a path stands twice in {twice['source_key']}: {twice['path']}")
        batch = uuid.uuid4().hex
        placed = chunks.join(keys, "source_key", "left_semi")
        places = taken.select(F.col("id").alias("document_id"), "source_kind", "path")
        placed = placed.drop("source_kind", "path").join(places, "document_id")
        self._write("documents", taken, batch)
        self._write("chunks", placed, batch)
        written = self._batch("chunks", batch).withColumnRenamed("id", "chunk_id")
        terms = written.select("source_key", "chunk_id", F.explode(tokens(F.col("content"))).alias("term")).groupBy("term", "chunk_id", "source_key").agg(F.count("*").alias("tf"))
        # sorted by term: a search reads the row groups of its terms only
        self._write("postings", terms.repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), batch, apart=False)
        self._write("lengths", written.select("source_key", "chunk_id", F.size(tokens(F.col("content"))).cast("long").alias("dl"), "path"), batch, apart=False)
        full = self._batch("documents", batch).select("source_key", F.lit(batch).alias("batch")).distinct()

        def change(last: dict) -> dict:
            kept = self._table(last["live"], _LIVE).join(keys, "source_key", "left_anti")
            live = self._new("live", kept.select("source_key", "batch").unionByName(full.join(keys, "source_key", "left_semi")))
            return last | {"live": live, "metadata": last["metadata"] | {"last_ingest_at": now, "schema_version": SCHEMA_VERSION}}

        self._commit(change)

    def _batch(self, name: str, batch: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, batch string").parquet(f"{self.folder.path}/data/{name}").where(F.col("batch") == batch).drop("batch")

    def _write(self, name: str, df: DataFrame, batch: str, apart: bool = True) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        by = ["batch", "source_key"] if apart else ["batch"]
        df.select(*columns).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy(*by).parquet(f"{self.folder.path}/data/{name}")

    def replace_source(self, source_key: str, documents: DataFrame, chunks: DataFrame, now: str) -> tuple[int, int]:
        """Replace one source; an empty input removes it. Returns the counts of its documents and chunks."""
        self.replace_sources(self.spark.createDataFrame([(source_key,)], "source_key string"), documents, chunks, now)
        mine = F.col("source_key") == source_key
        return self.documents.where(mine).count(), self.chunks.where(mine).count()

    def delete_sources(self, keys: DataFrame) -> None:
        self._commit(lambda last: last | {"live": self._new("live", self._table(last["live"], _LIVE).join(keys, "source_key", "left_anti").select("source_key", "batch"))})

    def delete_source(self, source_key: str) -> None:
        self.delete_sources(self.spark.createDataFrame([(source_key,)], "source_key string"))

    def vacuum(self) -> int:
        """Remove the batches, lists and states that the last state doesn't name; returns how many."""
        state, gone = self.snapshot(), 0
        live = {r["batch"] for r in self._table(state["live"], _LIVE).select("batch").distinct().collect()}  # one row a write
        for name in TABLES:
            for part in self.folder.names(f"data/{name}"):
                if part.startswith("batch=") and part[6:] not in live:
                    self.folder.delete(f"data/{name}/{part}")
                    gone += 1
        for kind in ("live", "manifests"):
            for part in self.folder.names(kind):
                if f"{kind}/{part}" != state[kind]:
                    self.folder.delete(f"{kind}/{part}")
                    gone += 1
        for part in self.folder.names("states"):
            if part.endswith(".json") and part != f"{state['number']:012d}.json":
                self.folder.delete(f"states/{part}")
        return gone

    def _change_manifests(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self._commit(lambda last: last | {"manifests": self._new("manifests", change(self._table(last["manifests"], MANIFESTS)).select([c.split()[0] for c in MANIFESTS.split(", ")]))})

    def record_manifests(self, fresh: DataFrame) -> None:
        self._change_manifests(lambda known: upsert_manifests(known, fresh))

    def record_manifest(self, source_key: str, source_kind: str, provider: str, root_locator: str, payload: dict, now: str, display_locator: str | None = None) -> None:
        shown = redact_url(root_locator) or root_locator
        display = redact_url(display_locator or root_locator) or display_locator or root_locator
        row = (source_key, source_kind, provider, shown, display, json.dumps(redact_deep(payload), sort_keys=True), now, now, now, "idle", None, 0, None, None)
        self.record_manifests(self.spark.createDataFrame([row], MANIFESTS))

    def record_rebuild(self, source_key: str, status: str, attempts: int, now: str, error: str | None = None) -> None:
        if status not in ("idle", "success", "failed"):
            raise ValueError(status)
        mine = F.col("source_key") == source_key
        changes = {"last_rebuild_status": status, "last_rebuild_error": None if error is None else redact_text_literal(error), "last_rebuild_attempts": attempts, "last_rebuild_at": now}
        if status == "success":
            changes["last_rebuild_success_at"] = now
        self._change_manifests(lambda known: known.withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}))

    def delete_manifest(self, source_key: str) -> None:
        self._change_manifests(lambda known: known.where(F.col("source_key") != source_key))

    def fingerprint(self) -> dict | None:
        raw = self.metadata().get("embedding_fingerprint")
        return json.loads(raw) if raw else None

    def set_fingerprint(self, f: Fingerprint | None) -> None:
        self.set_metadata("embedding_fingerprint", json.dumps(f.json(), sort_keys=True) if f else None)

    def state(self, wanted: Fingerprint) -> dict:
        return index_state(self.exists(), self.manifests.where("last_rebuild_status = 'failed'").count(), self.fingerprint(), wanted.json())

    def stats(self) -> dict:
        m = self.manifests.agg(F.count("*").alias("n"), F.count_if(F.col("last_rebuild_status") == "failed").alias("failed")).first()
        c = self.chunks.agg(F.count("*").alias("n"), F.count("embedding").alias("v")).first()
        return {
            "documents": self.documents.count(), "chunks": c["n"], "vectors": c["v"], "has_index": self.exists(),
            "manifests": m["n"], "failed": m["failed"], "fingerprint": self.fingerprint(),
        }

    def doctor(self, wanted: Fingerprint | None = None) -> dict:
        """missing, degraded or ok; writes nothing. Without a wanted fingerprint a stored one is enough."""
        if not self.exists():
            return {"status": "missing", "reason": "index bootstrap required"}
        stored = self.fingerprint()
        wanted_json = wanted.json() if wanted else (stored or {"": None})
        got = index_state(True, self.stats()["failed"], stored, wanted_json)
        return {"status": "degraded" if got["needs_rebuild"] else "ok", "reason": got["reason"]}

    def clear(self) -> None:
        self.folder.delete()

    def search(self, query: str, vector: list[float], limit: int = 8, suffixes: list[str] | None = None) -> DataFrame:
        """Hybrid search over the stored chunks, postings and lengths."""
        from . import fusion

        return fusion.search(self.searchable, query, vector, limit, suffixes, index=(self.postings, self.lengths))


def rebuild(store: Store, ingest, wanted: Fingerprint, now, *, source_key: str | None = None, failed_only: bool = False, retry: int = 2, fail_fast: bool = False) -> dict:
    """Ingest recorded sources again. ``ingest(manifest)`` raises on failure; ``now()`` gives the time.

    A single source or the failed ones alone are refused while the whole index has to be rebuilt.
    """
    manifests = [r.asDict() for r in store.manifests.orderBy("source_key").collect()]
    full = store.state(wanted)["full"]
    if source_key is not None and source_key not in {m["source_key"] for m in manifests}:
        raise ValueError(f"unknown source {source_key}")
    if full and (failed_only or (source_key is not None and len(manifests) > 1)):
        raise ValueError("a full rebuild is needed first")
    chosen = [m for m in manifests if (source_key is None or m["source_key"] == source_key) and (not failed_only or m["last_rebuild_status"] == "failed")]
    if not manifests and not failed_only:
        store.initialise()
    if chosen and not failed_only and (source_key is None or full):
        store.reset()
    result = {"rebuilt": [], "failed": [], "errors": {}}
    for m in chosen:
        error, attempts = None, 0
        for attempts in range(1, retry + 2):
            try:
                ingest(m)
                error = None
                break
            except Exception as e:  # noqa: BLE001 - any failure of a source is recorded, not raised
                error = str(e)
        store.record_rebuild(m["source_key"], "failed" if error else "success", attempts, now(), error)
        result["failed" if error else "rebuilt"].append(m["source_key"])
        if error:
            result["errors"][m["source_key"]] = redact_text_literal(error)
        if error and fail_fast:
            break
    if chosen and not result["failed"] and not failed_only:
        store.set_fingerprint(wanted)
        store.set_metadata("last_rebuild_at", now())
    return result
