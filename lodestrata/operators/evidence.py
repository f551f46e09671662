"""Multi-step evidence gathering with validated citations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.redaction import redact_text_literal

GUARD = re.compile(r"(BEGIN|END)_UNTRUSTED_EVIDENCE", re.I)


def merge(results: DataFrame, excerpts: DataFrame) -> DataFrame:
    """The best-scored result of each chunk (the earliest among equals), with its trimmed excerpt."""
    best = results.groupBy("chunk_id").agg(F.min_by(F.struct("document_id", "path", "section", "score"), F.struct((-F.col("score")).alias("s"), F.col("arrival"))).alias("r"))
    kept = best.select("chunk_id", "r.*").join(excerpts.select("chunk_id", T.trim_all(F.col("content")).alias("excerpt")), "chunk_id")
    return kept.where("excerpt is not null")


def rank(evidence: DataFrame, most: int) -> DataFrame:
    """The ``most`` best, numbered from 1."""
    order = [F.round("score", 12).desc(), F.col("document_id").asc(), F.col("chunk_id").asc()]
    return evidence.orderBy(*order).limit(most).withColumn("evidence_id", F.row_number().over(Window.orderBy(*order)))


def validate(citations: DataFrame, evidence: DataFrame, query: str) -> DataFrame:
    """(evidence_id, quote, valid): the first citation of each id; unknown ids are invalid.

    A quote stays only if it stands in the excerpt; without one the excerpt around the query is quoted.
    """
    first = citations.groupBy("evidence_id").agg(F.min_by(F.struct("quote"), "position").alias("q")).select("evidence_id", "q.quote")
    joined = first.join(evidence.select("evidence_id", "excerpt"), "evidence_id", "left")
    quote = F.when(F.col("excerpt").isNull(), None).when(F.col("quote").isNull(), T.verbatim_quote(F.col("excerpt"), query)).when(F.contains("excerpt", "quote"), F.col("quote"))
    return joined.select("evidence_id", quote.alias("quote"), F.col("excerpt").isNotNull().alias("valid"))


def neutral(text: str) -> str:
    """Prompt text that can't end the evidence block it stands in, and holds no secrets of URLs."""
    return GUARD.sub(lambda m: m[0][:1] + "​" + m[0][1:], redact_text_literal(text))


def block(e: dict) -> str:
    about = {"id": e["evidence_id"], "path": e["path"], "section": e["section"], "score": round(e["score"], 6)}
    return "\n".join(["BEGIN_UNTRUSTED_EVIDENCE", neutral(json.dumps(about, ensure_ascii=False)), neutral(e["excerpt"]), "END_UNTRUSTED_EVIDENCE"])


def fresh_queries(queries: list[str], used: set[str]) -> list[str]:
    """Trimmed queries not asked before, whatever their case."""
    out = []
    for q in (x.strip() for x in queries):
        if q and q.lower() not in used:
            used.add(q.lower())
            out.append(q)
    return out


class LanguageModel(Protocol):
    def plan(self, question: str, evidence: list[str]) -> dict: ...

    def answer(self, question: str, evidence: list[str], problems: list[str]) -> dict: ...


@dataclass
class Scripted:
    """A model that gives prepared replies; the last one repeats."""

    plans: list[dict]
    answers: list[dict]
    calls: dict[str, int] = field(default_factory=lambda: {"plan": 0, "answer": 0})

    def _next(self, kind: str, replies: list[dict]) -> dict:
        at = min(self.calls[kind], len(replies) - 1)
        self.calls[kind] += 1
        return replies[at]

    def plan(self, question: str, evidence: list[str]) -> dict:
        return self._next("plan", self.plans)

    def answer(self, question: str, evidence: list[str], problems: list[str]) -> dict:
        return self._next("answer", self.answers)


def cited(reply: dict) -> list[dict]:
    """Citations of a reply, else its bare ids; the first of each id."""
    raw = reply.get("citations") or [{"evidence_id": i} for i in reply.get("citation_ids") or []]
    out: dict[int, dict] = {}
    for c in raw:
        try:
            i = int(c["evidence_id"])
        except (KeyError, TypeError, ValueError):
            i = -1  # an unreadable id is known to nobody
        out.setdefault(i, {"evidence_id": i, "quote": c.get("quote") if isinstance(c, dict) else None})
    return list(out.values())


def ask(chunks: DataFrame, question: str, model: LanguageModel, search: Callable[[str], DataFrame], *, steps: int = 3, per_step: int = 3, most: int = 8) -> dict:
    """Plan, retrieve and answer. Evidence is bounded by ``most`` times the queries, so it fits the driver."""
    spark = chunks.sparkSession
    used: set[str] = set()
    asked: list[str] = []
    gathered: list[tuple] = []
    iterations = 0
    columns = "chunk_id long, document_id long, path string, section string, score double, arrival long"

    def ranked() -> list[dict]:
        if not gathered:
            return []
        results = spark.createDataFrame(gathered, columns)
        wanted = sorted({g[0] for g in gathered})
        return [r.asDict() for r in rank(merge(results, chunks.where(F.col("chunk_id").isin(wanted))), most).orderBy("evidence_id").collect()]

    for step in range(steps):
        reply = model.plan(question, [block(e) for e in ranked()])
        queries = fresh_queries((reply.get("queries") or [])[:per_step], used)
        if not queries and not asked:
            queries = fresh_queries([question], used)
        if not queries:
            iterations = step
            break
        for q in queries:
            asked.append(q)
            for r in search(q).collect():  # at most the search's limit
                gathered.append((r["chunk_id"], r["document_id"], r["path"], r["section"], r["score"], len(gathered)))
        iterations = step + 1
        if reply.get("enough"):
            break
    evidence = ranked()
    out = {"iterations": iterations, "queries": asked, "evidence": evidence}
    if not evidence:
        return out | {"status": "insufficient_evidence", "answer": "There is not enough evidence to answer.", "citations": []}
    shown, problems = [block(e) for e in evidence], []
    known = spark.createDataFrame([(e["evidence_id"], e["excerpt"]) for e in evidence], "evidence_id int, excerpt string")
    for _ in range(2):
        reply = model.answer(question, shown, problems)
        given = cited(reply)
        if given:
            rows = [(c["evidence_id"], c["quote"], n) for n, c in enumerate(given)]
            checked = [r.asDict() for r in validate(spark.createDataFrame(rows, "evidence_id int, quote string, position int"), known, question).orderBy("evidence_id").collect()]
            problems = [f"unknown evidence {c['evidence_id']}" for c in checked if not c["valid"]]
        else:
            checked, problems = [], ["no citation"]
        if not problems:
            return out | {"status": "grounded", "answer": reply.get("answer", ""), "citations": [{"evidence_id": c["evidence_id"], "quote": c["quote"]} for c in checked]}
    return out | {"status": "citation_validation_failed", "answer": "The answer's citations could not be verified.", "citations": []}
