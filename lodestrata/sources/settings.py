"""Settings: a TOML file against a table of types, ranges, choices and defaults; all faults are listed by path."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import Any

REQUIRED = object()


@dataclass(frozen=True)
class Rule:
    """What a setting may be: its type, default, bounds (of a number, or of a text's length) and choices."""

    kind: type
    default: Any = REQUIRED
    least: float | None = None
    most: float | None = None
    choices: tuple = ()

    def fault(self, value: Any) -> str | None:
        if self.kind is list:
            return None if isinstance(value, list) and all(isinstance(v, str) and v for v in value) else "must be a list of texts"
        if not isinstance(value, self.kind) or (self.kind is not bool and isinstance(value, bool)):
            return f"must be of type {self.kind.__name__}"
        if self.choices and value not in self.choices:
            return "must be one of " + ", ".join(self.choices)
        size = len(value) if isinstance(value, str) else value
        if self.least is not None and size < self.least:
            return f"must be at least {self.least}" + (" characters" if isinstance(value, str) else "")
        if self.most is not None and size > self.most:
            return f"must be at most {self.most}"
        return None


def _service(**more: Rule) -> dict[str, Rule]:
    """Settings of every service: rate limits a minute (0: none) and retries."""
    return more | {"rpm": Rule(int, 0, 0), "tpm": Rule(int, 0, 0), "retry_max_retries": Rule(int, 3, 0, 20), "retry_delay_seconds": Rule(int, 10, 0, 600)}


_CRAWL = {"default_fetch_mode": Rule(str, "auto", choices=("auto", "get", "fetch")), "default_crawl": Rule(bool, False), "min_markdown_chars": Rule(int, 200, 1)}

#: Tables of settings by their dotted names.
RULES: dict[str, dict[str, Rule]] = {
    "app": {"default_output": Rule(str, "text", choices=("text", "json")), "project_dir_name": Rule(str, ".lodestrata", 1)},
    "web.search": {"provider": Rule(str, "none", 1)},
    "web.search.service": _service(api_key_env=Rule(str, "SEARCH_API_KEY", 1), default_topic=Rule(str, "general", choices=("general", "news", "finance")), default_search_depth=Rule(str, "basic", choices=("advanced", "basic", "fast", "ultra-fast"))),
    "web.ingest": {"provider": Rule(str, "command", choices=("recorded", "command", "service"))},
    "web.ingest.command": _service(
        command=Rule(str, "crawler", 1), default_max_pages=Rule(int, 25, 1, 500), default_max_depth=Rule(int, 2, 0, 10),
        get_page_timeout_ms=Rule(int, 30_000, 1000, 300_000), fetch_page_timeout_ms=Rule(int, 60_000, 1000, 300_000), **_CRAWL,
    ),
    "web.ingest.service": _service(
        api_token_env=Rule(str, "CRAWL_API_TOKEN", 1), default_max_pages=Rule(int, 25, 1, 100_000), default_max_depth=Rule(int, 2, 0, 100_000), poll_interval_ms=Rule(int, 10_000, 250, 30_000),
        max_poll_attempts=Rule(int, 60, 1, 1000), source=Rule(str, "all", choices=("all", "sitemaps", "links")), include_external_links=Rule(bool, False), include_subdomains=Rule(bool, False),
        include_patterns=Rule(list, []), exclude_patterns=Rule(list, []), **_CRAWL,
    ),
    "embedding": {
        "provider": Rule(str, "hashed", 1), "model": Rule(str, "words", 1), "dimensions": Rule(int, 32, 1, 3072),
        "task_type": Rule(str, "RETRIEVAL_DOCUMENT", choices=("RETRIEVAL_DOCUMENT", "SEMANTIC_SIMILARITY", "CLASSIFICATION", "CLUSTERING", "QUESTION_ANSWERING", "FACT_VERIFICATION")),
    },
    "llm": _service(provider=Rule(str, "scripted", 1), model=Rule(str, "scripted", 1)),
    "rerank": {"provider": Rule(str, "none", choices=("none",))},
    "ai_search": {"max_steps": Rule(int, 3, 1, 10), "max_queries_per_step": Rule(int, 3, 1, 10), "retrieval_limit": Rule(int, 8, 1, 50), "max_evidence_chunks": Rule(int, 12, 1, 50)},
    "index": {
        "chunk_size": Rule(int, 1200, 200, 16_000), "chunk_overlap": Rule(int, 150, 0, 4000), "chunking_version": Rule(str, "v1", 1),
        "fts": Rule(bool, True), "vector": Rule(bool, True), "max_file_bytes": Rule(int, 262_144, 1024),
    },
}


def check(values: dict, rules: dict[str, dict[str, Rule]] | None = None) -> dict[str, dict[str, Any]]:
    """Settings by table and name, defaults filled in; a ValueError names every fault by its path."""
    out, faults = {}, []
    for table, fields in (rules or RULES).items():
        at: Any = values
        for part in table.split("."):
            at = at.get(part, {}) if isinstance(at, dict) else at
        if not isinstance(at, dict):
            faults.append(f"{table}: must be a table")
            continue
        out[table] = {}
        for name, rule in fields.items():
            value = at.get(name, rule.default)
            fault = "is required" if value is REQUIRED else rule.fault(value)
            if fault:
                faults.append(f"{table}.{name}: {fault}")
            out[table][name] = value
    if faults:
        raise ValueError("; ".join(faults))
    return out


def load(path: str | None = None, rules: dict[str, dict[str, Rule]] | None = None) -> dict[str, dict[str, Any]]:
    """A settings file, by default ``lodestrata.toml`` here; without one all defaults hold."""
    at = Path(path) if path else Path("lodestrata.toml")
    if not at.exists():
        if path:
            raise FileNotFoundError(path)
        return check({}, rules)
    return check(tomllib.loads(at.read_text("utf-8")), rules)


def index_folder(project: bool, settings: dict[str, dict[str, Any]], root: str | None = None) -> str:
    """The folder of an index: beside the project, or the user's own."""
    name = settings["app"]["project_dir_name"]
    return str(Path(root or (os.getcwd() if project else os.path.expanduser("~"))) / name / "index")
