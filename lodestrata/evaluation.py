"""The offline evaluation: four files are learned, searched and asked about, and its counts compared with known ones."""

from __future__ import annotations

import json
import subprocess
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.embedding import KeywordEmbedder
from lodestrata.operators import chunking, evidence, fusion

# The evaluation's files, settings and queries, whose counts are published.
FILES = {
    "README.md": "# Offline Eval Fixture\n\nThis fixture exercises hybrid retrieval for grounded local answers.\nIt combines vector search, FTS search, and evidence-aware summaries.\n",
    "docs/retrieval.md": "# Retrieval Notes\n\nHybrid retrieval keeps the offline fixture deterministic.\nVector search finds semantic matches, while keyword search preserves exact evidence anchors.\nThe eval baseline expects evidence counts to remain stable.\n",
    "src/search-index.ts": "export function buildHybridRetrievalSummary() {\n  return 'Hybrid retrieval fuses vector search with keyword evidence for local agents.';\n}\n\nexport function rankEvidencePaths() {\n  return ['README.md', 'docs/retrieval.md'];\n}\n",
    "src/answer.ts": "export function answerWithEvidence() {\n  return 'Grounded answers cite local evidence and avoid network dependencies.';\n}\n",
}
SEARCH, QUESTION = "hybrid retrieval evidence", "What keeps the offline eval fixture grounded?"
SIZE, OVERLAP, LIMIT = 140, 20, 3
WORDS = ("hybrid", "retrieval", "vector", "search", "evidence", "grounded")
BASELINE = {
    "schemaVersion": 1, "fixture.name": "offline-eval-perf", "fixture.searchQuery": SEARCH, "fixture.aiSearchQuery": QUESTION, "fixture.sourceFiles": 4,
    "metrics.dataset.documentsIndexed": 4, "metrics.dataset.chunksIndexed": 6, "metrics.dataset.skippedSymlinks": 0,
    "metrics.search.limit": 3, "metrics.search.results": 3, "metrics.search.retrieversUsed": "vector,fts,metadata", "metrics.search.vectorCandidates": 6, "metrics.search.ftsCandidates": 6,
    "metrics.search.lexicalCandidates": 0, "metrics.search.metadataCandidates": 5,
    "metrics.aiSearch.limit": 3, "metrics.aiSearch.maxSteps": 1, "metrics.aiSearch.maxQueriesPerStep": 1, "metrics.aiSearch.maxEvidenceChunks": 3, "metrics.aiSearch.iterations": 1,
    "metrics.aiSearch.usedQueries": 1, "metrics.aiSearch.evidence": 3, "metrics.aiSearch.citations": 1, "metrics.aiSearch.groundingStatus": "grounded", "metrics.aiSearch.structuredOutputFallbackUsed": False,
    "metrics.llm.plannerCalls": 1, "metrics.llm.answerCalls": 1, "metrics.llm.totalCalls": 2,
}
EMBEDDER = KeywordEmbedder(WORDS)


def chunks(spark: SparkSession) -> DataFrame:
    """The files' chunks as the retrievers read them, without a store."""
    rows = spark.createDataFrame([(n, p, t) for n, (p, t) in enumerate(sorted(FILES.items()), 1)], "id long, path string, content string")
    made = chunking.chunk(rows, SIZE, OVERLAP).join(rows.select(F.col("id").alias("document_id"), "path"), "document_id")
    named = made.withColumns({"chunk_id": F.col("document_id") * 100 + F.col("chunk_index"), "source_key": F.lit("fixture"), "source_kind": F.lit("local_git"), "embedding": EMBEDDER.embed(F.col("content"))})
    return named.select("chunk_id", "document_id", "source_key", "source_kind", "path", "section", "content", "embedding")


def write_files(folder: str) -> None:
    """The files as a repository."""
    for name, text in FILES.items():
        at = Path(folder, name)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, "utf-8")
    for args in (["init", "-q"], ["add", "-A"]):
        subprocess.run(["git", *args], cwd=folder, check=True, capture_output=True)


def measure(rows: DataFrame, documents: int, symlinks: int = 0, index=None) -> tuple[dict, dict[str, float]]:
    """(metrics, milliseconds) of searching and asking over learned chunks."""
    vector, spent = EMBEDDER.embed_query(SEARCH), {}
    began = time.time()
    found = fusion.search(rows, SEARCH, vector, LIMIT, index=index).collect()
    d = fusion.diagnostics(rows, SEARCH, vector, LIMIT, index=index).first()
    spent["search"] = (time.time() - began) * 1000
    model = evidence.Scripted([{"queries": [SEARCH], "enough": True}], [{"answer": "It is grounded in local evidence.", "citations": [{"evidence_id": 1, "quote": None}]}])
    began = time.time()
    asked = evidence.ask(rows, QUESTION, model, lambda q: fusion.search(rows, q, EMBEDDER.embed_query(q), LIMIT, index=index), steps=1, per_step=1, most=3)
    spent["aiSearch"] = (time.time() - began) * 1000
    values = [
        1, "offline-eval-perf", SEARCH, QUESTION, len(FILES), documents, rows.count(), symlinks, LIMIT, len(found), d["retrievers_used"], d["vector_candidates"], d["fts_candidates"], d["lexical_candidates"],
        d["metadata_candidates"], LIMIT, 1, 1, 3, asked["iterations"], len(asked["queries"]), len(asked["evidence"]), len(asked["citations"]), asked["status"], False,
        model.calls["plan"], model.calls["answer"], model.calls["plan"] + model.calls["answer"],
    ]
    return dict(zip(BASELINE, values)), spent


def run(spark: SparkSession, folder: str) -> tuple[dict, dict[str, float]]:
    """The whole evaluation in an empty folder: a repository is made, learned, searched and asked about."""
    from lodestrata.operators.ingest import Learner
    from lodestrata.operators.store import Store

    began = time.time()
    write_files(f"{folder}/repository")
    spent = {"fixtureSetup": (time.time() - began) * 1000}
    learner = Learner(spark, Store(spark, f"{folder}/index"), EMBEDDER, lambda: "2026-01-01T00:00:00Z", SIZE, OVERLAP)
    at = time.time()
    learned = learner.learn_git(f"{folder}/repository")
    spent["learnGit"] = (time.time() - at) * 1000
    store = learner.store
    metrics, more = measure(store.searchable, learned.documents, learned.skipped.get("symlink", 0), (store.postings, store.lengths))
    return metrics, spent | more | {"total": (time.time() - began) * 1000}


def compare(baseline: dict, current: dict, timings: tuple[dict, dict] | None = None, ratio: float = 1.5, buffer_ms: float = 25) -> list[dict]:
    """What differs: counts exactly, and timings (baseline, current) only if they are given, beyond both margins."""
    out = [{"metric": k, "expected": baseline[k], "actual": current.get(k)} for k in BASELINE if baseline.get(k) != current.get(k)]
    for k, known in (timings[0] if timings else {}).items():
        most = max(known * ratio, known + buffer_ms)
        if timings[1].get(k, 0) > most:
            out.append({"metric": f"timingsMs.{k}", "expected": most, "actual": timings[1][k]})
    return out


def write_baseline(path: str, metrics: dict, spent: dict[str, float]) -> None:
    Path(path).write_text(json.dumps({"metrics": metrics, "timingsMs": {k: round(v) for k, v in spent.items()}}, indent=2) + "\n", "utf-8")


def read_baseline(path: str) -> tuple[dict, dict[str, float]]:
    try:
        value = json.loads(Path(path).read_text("utf-8"))
    except ValueError as e:
        raise ValueError(f"the baseline {path} is no JSON: {e}") from e
    missing = [k for k in BASELINE if k not in value.get("metrics", {})]
    if missing:
        raise ValueError(f"the baseline {path} lacks " + ", ".join(missing))
    return value["metrics"], value.get("timingsMs", {})


__all__ = ["BASELINE", "FILES", "chunks", "compare", "measure", "read_baseline", "run", "write_baseline", "write_files"]
