"""The command line: learn, search, get, ask, web search, the index's state, and the offline evaluation.

Everything printed is redacted. ``Context`` holds what a command works with; its services (page
source, embedder, model, web search) are set by the program that embeds the engine, or are the
offline ones.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata import evaluation
from lodestrata.functions.embedding import EmbeddingProvider, HashedEmbedder
from lodestrata.functions.redaction import redact_deep, redact_text_literal
from lodestrata.functions.text import normalize_suffixes
from lodestrata.operators import evidence, fusion, lookup
from lodestrata.operators.ingest import Learner
from lodestrata.operators.store import Store
from lodestrata.progress import Progress
from lodestrata.session import local_session
from lodestrata.sources import settings as S
from lodestrata.sources import webpages

PROGRAM = "lodestrata"


def printed(value: Any, as_json: bool) -> str:
    """Text as it is, other values (and all with ``as_json``) as JSON; without secrets."""
    if isinstance(value, str) and not as_json:
        return redact_text_literal(value)
    return json.dumps(redact_deep(value), indent=2, ensure_ascii=False, default=str)


# --- text forms -----------------------------------------------------------------------------------


def _lines(pairs: dict[str, Any]) -> list[str]:
    def shown(v: Any) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else json.dumps(v, sort_keys=True) if isinstance(v, dict) else str(v)

    return [f"{k}: {shown(v)}" for k, v in pairs.items()]


def stats_text(scope: str, folder: str, stats: dict) -> str:
    return "\n".join(_lines({"scope": scope, "index": folder, **{k: stats[k] for k in ("documents", "chunks")}, "sources": stats["manifests"], "failed_sources": stats["failed"], "vectors": stats["vectors"], "fingerprint": stats["fingerprint"]}))


def doctor_text(scope: str, folder: str, report: dict) -> str:
    return "\n".join(_lines({"scope": scope, "index": folder, "health_status": report["status"], "rebuild_reason": report["reason"]}))


def scope_text(scope: str, folder: str, stats: dict, manifests: list[dict]) -> str:
    out = [stats_text(scope, folder, stats)]
    for m in manifests:
        about = {"kind": m["source_kind"], "provider": m["provider"], "root": m["root_locator"], "rebuild_status": m["last_rebuild_status"], "rebuild_attempts": m["last_rebuild_attempts"]}
        if m["last_rebuild_error"]:
            about["rebuild_error"] = m["last_rebuild_error"]
        out += ["", f"[source] {m['source_key']}", *_lines(about)]
    return "\n".join(out)


def document_text(scope: str, folder: str, d: dict) -> str:
    named = ("source_key", "source_kind", "source_locator", "canonical_locator", "path", "language", "title", "content_hash")
    return "\n".join([*_lines({"scope": scope, "index": folder, "document_id": d["id"], **{k: d[k] for k in named}}), "", d["content"] or ""])


def results_text(scope: str, folder: str, query: str, suffixes: list[str], results: list[dict]) -> str:
    head = {"query": query, "scope": scope, "index": folder} | ({"extensions": ", ".join(suffixes)} if suffixes else {}) | {"results": len(results)}
    out = _lines(head)
    for n, r in enumerate(results, 1):
        out += ["", f"[{n}] {r['path']}", *_lines({"document_id": r["document_id"], "source_key": r["source_key"], "section": r["section"], "score": f"{r['score']:.6f}", "snippet": r["snippet"]})]
    return "\n".join(out)


def get_command(document_id: int, scope: str) -> str:
    """The command that shows a cited document whole."""
    return f"{PROGRAM} get --document-id {document_id}" + (" --project" if scope == "project" else "")


def answer_text(scope: str, folder: str, question: str, reply: dict) -> str:
    by = {e["evidence_id"]: e for e in reply["evidence"]}
    out = _lines({"query": question, "scope": scope, "index": folder, "iterations": reply["iterations"], "grounding_status": reply["status"]})
    out += ["", "answer:", reply["answer"], "", f"used_queries: {len(reply['queries'])}", *(f"- {q}" for q in reply["queries"])]
    if reply.get("fell_back"):
        out.append("structured_output_fallback_used: true")
    out += ["", f"citations: {len(reply['citations'])}"]
    for c in reply["citations"]:
        e = by[c["evidence_id"]]
        out += [f"[{c['evidence_id']}] doc={e['document_id']} {e['path']} :: {e['section']}", f"get: {get_command(e['document_id'], scope)}"]
    return "\n".join(out)


# --- what commands work with ----------------------------------------------------------------------


@dataclass
class Context:
    """Session, services and settings of a run; progress and tokens go to ``progress``."""

    session: Callable[[], SparkSession] = local_session
    embedder: EmbeddingProvider = field(default_factory=HashedEmbedder)
    pages: webpages.PageSource | None = None
    model: evidence.LanguageModel | None = None
    web_search: Callable[[str], dict] | None = None
    root: str | None = None
    out: Callable[[str], None] = print
    progress: Progress = field(default_factory=Progress)

    def learner(self, args: argparse.Namespace, ensure: bool = False) -> tuple[Learner, str, str, dict]:
        """(learner, scope, folder, settings); ``ensure``: bring the index up to date first."""
        settings = S.load(args.config)
        scope = "project" if args.project else "global"
        folder = S.index_folder(args.project, settings, self.root)
        spark = self.session()
        i = settings["index"]
        now = lambda: datetime.datetime.now(datetime.UTC).isoformat()
        pages = self.pages
        if pages is None:
            w = settings["web.ingest.command"]
            pages = webpages.CommandPages(w["command"], {"get": w["get_page_timeout_ms"], "fetch": w["fetch_page_timeout_ms"]})
        retry = settings["web.ingest.command"]
        learner = Learner(spark, Store(spark, folder), self.embedder, now, i["chunk_size"], i["chunk_overlap"], i["max_file_bytes"], f"{folder}-repositories", pages, retry["retry_max_retries"], retry["retry_delay_seconds"], self.progress)
        if ensure:
            learner.ensure()
        return learner, scope, folder, settings


def ask_options(settings: dict, args: argparse.Namespace) -> dict[str, int]:
    """What the command says, else the settings."""
    s = settings["ai_search"]
    given = {"limit": (args.limit, "retrieval_limit"), "steps": (args.max_steps, "max_steps"), "per_step": (args.max_queries, "max_queries_per_step"), "most": (args.max_evidence, "max_evidence_chunks")}
    return {k: s[name] if v is None else v for k, (v, name) in given.items()}


def _learn(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    learner, scope, folder, settings = c.learner(a, ensure=True)
    w = settings["web.ingest.command"]
    if a.kind == "git":
        got = learner.learn_git(a.source)
    else:
        got = learner.learn_web(a.source, a.crawl or w["default_crawl"], a.max_pages or w["default_max_pages"], a.max_depth if a.max_depth is not None else w["default_max_depth"], a.fetch_mode or w["default_fetch_mode"])
    value = {"scope": scope, "index": folder, **got.__dict__}
    shown = {k: value[k] for k in ("scope", "index", "source_key", "documents", "chunks")} | {"failures": len(got.failures)}
    return value, "\n".join(_lines(shown)), 0


def _search(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    learner, scope, folder, _ = c.learner(a, ensure=True)
    suffixes = normalize_suffixes(a.ext or [])
    rows = [r.asDict() for r in learner.store.search(a.query, c.embedder.embed_query(a.query), a.limit, suffixes).collect()]
    return {"query": a.query, "scope": scope, "index": folder, "extensions": suffixes, "results": rows}, results_text(scope, folder, a.query, suffixes, rows), 0


def _get(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    if bool(a.path) == bool(a.document_id):
        raise ValueError("give either a path or a document id")
    learner, scope, folder, _ = c.learner(a)
    found = lookup.get(learner.store.documents, a.path, a.document_id, a.source)
    return {"scope": scope, "index": folder, "document": found}, document_text(scope, folder, found), 0


def _ask(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    if c.model is None:
        raise ValueError("no language model is set")
    learner, scope, folder, settings = c.learner(a, ensure=True)
    o = ask_options(settings, a)
    search = lambda q: learner.store.search(q, c.embedder.embed_query(q), o["limit"])
    reply = evidence.ask(learner.store.searchable, a.query, c.model, search, steps=o["steps"], per_step=o["per_step"], most=o["most"])
    reply["fell_back"] = getattr(c.model, "fell_back", False)
    if usage := getattr(c.model, "usage", None):
        reply["tokens"] = {"input": usage.input, "output": usage.output, "estimated": usage.estimated}
    return {"query": a.query, "scope": scope, "index": folder, **reply}, answer_text(scope, folder, a.query, reply), 0


def _db(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    scope = lookup.one_scope(a.everywhere, a.project)
    learner, _, folder, _ = c.learner(a)
    store = learner.store
    if a.action == "stats":
        stats = store.stats()
        return {"scope": scope, "index": folder, **stats}, stats_text(scope, folder, stats), 0
    if a.action == "doctor":
        report = store.doctor(c.embedder.fingerprint())
        return {"scope": scope, "index": folder, **report}, doctor_text(scope, folder, report), 0
    if a.action == "scope":
        manifests = [r.asDict() for r in store.manifests.orderBy("source_key").collect()]  # one row a source, to be printed
        stats = store.stats()
        return {"scope": scope, "index": folder, "stats": stats, "sources": manifests}, scope_text(scope, folder, stats, manifests), 0
    if a.action == "clear":
        if not a.yes:
            raise ValueError("clearing an index needs --yes")
        store.clear()
        return {"scope": scope, "index": folder, "cleared": True}, f"cleared: {folder}", 0
    done = learner.rebuild(source_key=a.source, failed_only=a.failed_only, retry=a.retry, fail_fast=a.fail_fast)
    return {"scope": scope, "index": folder, **done}, "\n".join(_lines({"rebuilt": len(done["rebuilt"]), "failed": len(done["failed"]), **done["errors"]})), 1 if done["failed"] else 0


def _web(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    if c.web_search is None:
        raise ValueError("no web search is set")
    rows = [r.asDict() for r in webpages.search_results(c.session(), c.web_search(a.query)).orderBy("rank").collect()]
    return {"query": a.query, "results": rows}, "\n".join([f"query: {a.query}", *(f"[{r['rank']}] {r['title']}\n{r['url']}\n{r['content']}" for r in rows)]), 0


def _eval(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    with tempfile.TemporaryDirectory() as folder:  # a repository of four files, on the driver
        metrics, spent = evaluation.run(c.session(), folder)
    known, timings = evaluation.read_baseline(a.baseline) if a.baseline and a.check else (evaluation.BASELINE, {})
    found = evaluation.compare(known, metrics, (timings, spent) if a.timings else None)
    if a.baseline and not a.check:
        evaluation.write_baseline(a.baseline, metrics, spent)
    value = {"status": "failed" if found else "passed", "metrics": metrics, "timingsMs": spent, "regressions": found}
    return value, "\n".join(_lines({"status": value["status"], "checked": len(evaluation.BASELINE), **metrics})), 1 if found else 0


def _smoke(c: Context, a: argparse.Namespace) -> tuple[Any, str, int]:
    """One small call of each service that is set, and whether a secret of the environment shows in what they gave."""
    steps: dict[str, Any] = {"embedding": len(c.embedder.embed_query("smoke test"))}
    if c.web_search is not None:
        steps["web_search"] = webpages.search_results(c.session(), c.web_search("smoke test")).limit(1).count()
    if c.pages is not None and a.page:
        steps["page"] = len(webpages.fetch_pages(c.session().createDataFrame([(a.page,)], "url string"), c.pages, "auto", 0, least_chars=1).first()["record"] or "")
    if c.model is not None:
        rows = evaluation.chunks(c.session()).withColumn("embedding", c.embedder.embed(F.col("content")))
        reply = evidence.ask(rows, evaluation.QUESTION, c.model, lambda q: fusion.search(rows, q, c.embedder.embed_query(q), 1), steps=1, per_step=1, most=1)
        steps["answer"] = reply["status"]
    shown = printed(steps, True)
    secrets = [v for k, v in os.environ.items() if k.endswith(("_KEY", "_TOKEN", "_SECRET")) and len(v) >= 8]
    leaked = any(v in shown for v in secrets)
    return {"status": "leaked" if leaked else "passed", **({} if leaked else steps)}, f"status: {'leaked' if leaked else 'passed'}", 1 if leaked else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=PROGRAM)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, scoped: bool = True) -> argparse.ArgumentParser:
        q = commands.add_parser(name)
        q.add_argument("--config")
        q.add_argument("--json", action="store_true")
        if scoped:
            q.add_argument("--project", action="store_true")
        q.set_defaults(run=run)
        return q

    q = command("learn", _learn)
    q.add_argument("kind", choices=("git", "web"))
    q.add_argument("source")
    q.add_argument("--crawl", action="store_true")
    q.add_argument("--max-pages", type=int)
    q.add_argument("--max-depth", type=int)
    q.add_argument("--fetch-mode", choices=webpages.MODES)
    q = command("search", _search)
    q.add_argument("query")
    q.add_argument("--ext", action="append")
    q.add_argument("--limit", type=int, default=8)
    q = command("get", _get)
    q.add_argument("path", nargs="?")
    q.add_argument("--document-id", type=int)
    q.add_argument("--source")
    q = command("ai-search", _ask)
    q.add_argument("query")
    for name in ("--limit", "--max-steps", "--max-queries", "--max-evidence"):
        q.add_argument(name, type=int)
    q = command("db", _db)
    q.add_argument("action", choices=("stats", "doctor", "scope", "clear", "rebuild"))
    q.add_argument("--global", dest="everywhere", action="store_true")
    q.add_argument("--yes", action="store_true")
    q.add_argument("--source")
    q.add_argument("--retry", type=int, default=2)
    q.add_argument("--fail-fast", action="store_true")
    q.add_argument("--failed-only", action="store_true")
    q = command("web", _web, scoped=False)
    q.add_argument("action", choices=("search",))
    q.add_argument("query")
    q = command("smoke", _smoke, scoped=False)
    q.add_argument("--page")
    q = command("eval", _eval, scoped=False)
    q.add_argument("--baseline")
    q.add_argument("--check", action="store_true")
    q.add_argument("--timings", action="store_true")
    return p


def main(argv: list[str] | None = None, context: Context | None = None) -> int:
    """Run a command; errors go redacted to standard error, with exit code 1."""
    c = context or Context()
    args = parser().parse_args(argv)
    try:
        value, text, code = args.run(c, args)
        c.out(printed(value if args.json else text, args.json))
        return code
    except Exception as e:  # noqa: BLE001 - the top level
        print(redact_text_literal(f"{type(e).__name__}: {e}"), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
