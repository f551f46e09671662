"""Sources: tracked files of a local or remote repository with ordered skip rules, and environment files."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.redaction import network_url

# Suffixes of files that are never read, folder and file names likewise, languages by suffix.
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".tgz", ".mp3", ".mp4", ".mov", ".wav", ".woff", ".woff2", ".ttf", ".eot",
    ".so", ".dll", ".dylib", ".exe", ".bin", ".class", ".jar", ".wasm", ".sqlite", ".db", ".lock",
)
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", ".next", ".nuxt", ".parcel-cache", ".svelte-kit", ".turbo", ".cache", ".venv", "venv", "__pycache__", "node_modules",
    "dist", "build", "coverage", "vendor", "target", "out", "tmp", "temp",
)
SKIPPED_FILES = (".ds_store", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb")
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "json": "json", "rs": "rust", "py": "python", "go": "go", "md": "markdown",
    "mdx": "markdown", "toml": "toml", "yaml": "yaml", "yml": "yaml", "sh": "shell", "bash": "shell", "zsh": "shell", "txt": "text",
}
MOST_BYTES = 262144


class GitTimeout(RuntimeError):
    pass


class GitFailed(RuntimeError):
    pass


def is_remote(source: str) -> bool:
    return re.match(r"(?:https?|ssh|file|git)://|git@", source) is not None


def git(args: list[str], cwd: str | None = None, timeout_ms: int = 30_000) -> str:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=timeout_ms / 1000, check=False)
    except subprocess.TimeoutExpired as e:
        raise GitTimeout(f"git {args[0]} took more than {timeout_ms} ms") from e
    if done.returncode:
        raise GitFailed(f"git {args[0]} ended with {done.returncode}: {done.stderr.strip()[:400]}")
    return done.stdout


@dataclass(frozen=True)
class GitSource:
    """Where a repository's files are read from, and the key that its rows go by."""

    kind: str
    key: str
    locator: str
    root: str
    url: str | None


def remote_cache(url: str, folder: str, timeout_ms: int = 30_000) -> str:
    """A shallow copy of a remote repository in ``folder``, brought up to date; secrets of its URL aren't kept."""
    safe = network_url(url.strip())
    at = Path(folder, hashlib.sha256(safe.encode()).hexdigest())
    if at.exists():
        git(["-C", str(at), "fetch", "--depth=1", safe, "HEAD"], None, timeout_ms)
        git(["-C", str(at), "reset", "--hard", "FETCH_HEAD"], None, timeout_ms)
    else:
        at.parent.mkdir(parents=True, exist_ok=True)
        git(["clone", "--depth=1", safe, str(at)], None, timeout_ms)
    git(["-C", str(at), "remote", "set-url", "origin", safe], None, timeout_ms)
    return str(at)


def resolve_git(source: str, cache: str, timeout_ms: int = 30_000) -> GitSource:
    """A remote source goes by its URL without secrets, a local one by the top folder of its repository."""
    if is_remote(source):
        safe = network_url(source.strip())
        return GitSource("remote_git", safe, safe, remote_cache(source, cache, timeout_ms), safe)
    path = str(Path(source).absolute())
    root = git(["-C", path, "rev-parse", "--show-toplevel"], None, timeout_ms).strip()
    return GitSource("local_git", root, path, root, None)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    bare = F.substring(extension(path), 2, 64)
    return F.when(bare == "", "text").otherwise(F.coalesce(F.try_element_at(table, bare), bare))


def ignored(path: Column) -> Column:
    segments = F.transform(F.split(path, "/"), lambda s: F.lower(F.trim(s)))
    return F.exists(segments, lambda s: s.isin(*SKIPPED_FOLDERS)) | F.element_at(segments, -1).isin(*SKIPPED_FILES) | extension(path).isin(*BINARY)


def looks_binary(content: Column) -> Column:
    """NUL bytes, no valid UTF-8, or more than a tenth control bytes among the first 8192."""
    head = F.substring(content, 1, 8192)
    text = F.decode(F.when(F.is_valid_utf8(head.cast("string")), head), "UTF-8")
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]", ""))
    return F.when(F.length(content) == 0, False).otherwise(F.coalesce(F.contains(text, F.lit("\u0000")) | (control > 0.1 * F.octet_length(head)), F.lit(True)))


def scan(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``files`` (path, symlink, length, content, ...) with ``reason``: null for files to keep; other columns stay."""
    more = [c for c in files.columns if c not in ("path", "symlink", "length", "content")]
    text = F.decode(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content")), "UTF-8")
    reason = (
        F.when(F.col("symlink"), "symlink").when(ignored(F.col("path")), "ignored").when(F.col("length") > most_bytes, "too_large")
        .when(looks_binary(F.col("content")), "binary").when(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}\x{FEFF}]+", "") == "", "empty")
    )
    return files.select(*more, "path", "length", text.alias("text"), language(F.col("path")).alias("language"), reason.alias("reason"))


def read_repository(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, timeout_ms: int = 30_000) -> tuple[DataFrame, list[dict]]:
    """(scan of the tracked files, files that can't be read). Symbolic links are known from the listing."""
    top = Path(git(["rev-parse", "--show-toplevel"], root, timeout_ms).strip())
    tracked = [p for p in git(["ls-files", "-z"], str(top), timeout_ms).split("\0") if p]
    failures, plain, rows = [], [], []
    for p in tracked:
        try:
            link = os.path.islink(top / p)
            size = 0 if link else os.stat(top / p).st_size
        except OSError as e:
            failures.append({"path": p, "stage": "stat", "error": e.strerror})
            continue
        rows.append((p, link, size))
        if not link:
            plain.append(str(top / p))
    listed = spark.createDataFrame(rows, "path string, symlink boolean, size long")
    if not plain:
        return scan(listed.select("path", "symlink", F.col("size").alias("length"), F.lit(None).cast("binary").alias("content")), most_bytes), failures
    read = spark.read.format("binaryFile").load(plain).select(F.regexp_replace("path", "^file:/*", "/").alias("full"), "content")
    joined = listed.withColumn("full", F.concat(F.lit(f"{top}/"), "path")).join(read, "full", "left")
    return scan(joined.select("path", "symlink", F.col("size").alias("length"), "content"), most_bytes), failures


def load_env(path: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Variables of an environment file: the first definition holds, existing ones aren't overridden."""
    out: dict[str, str] = {}
    for line in Path(path).read_text("utf-8").splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if m:
            value = m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "\"'" else m[2]
            out.setdefault(m[1], value)
    return {k: v for k, v in out.items() if k not in (os.environ if environment is None else environment)}
