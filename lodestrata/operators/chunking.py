"""Chunking of documents, and its inverse. Row generators as Arrow UDFs: the cursor of a sliding
window depends on the piece before it, which no built-in expression states as simply."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

_BLANK = "".join(chr(c) for c in (*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
PIECE = "array<struct<section:string,content:string>>"


def is_markdown(path: Column) -> Column:
    return F.regexp_like(F.lower(path), F.lit(r"[^/]\.(md|mdx|markdown)$"))


def markdown_sections(text: str, basename: str) -> list[tuple[str, str]]:
    """(section, text): a heading names what follows and isn't part of it; blank sections are dropped."""
    out: list[tuple[str, list[str]]] = [(basename, [])]
    for line in text.split("\n"):
        m = _HEADING.fullmatch(line.rstrip("\r"))
        if m:
            out.append((m[2].strip(_BLANK), []))
        else:
            out[-1][1].append(line)
    kept = [(s, body) for s, lines in out if (body := "\n".join(lines).strip(_BLANK))]
    return kept or [(basename, text.strip(_BLANK))]


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters that end at a line or a blank where one is near enough."""
    text, out, at = text.strip(_BLANK), [], 0
    n = len(text)
    if n <= size:
        return [text] if text else []
    while True:
        end = ideal = min(n, at + size)
        if ideal < n:
            b = max(text.rfind("\n", 0, ideal + 1), text.rfind(" ", 0, ideal + 1))
            if b > at + int(0.6 * size):
                end = b
        if piece := text[at:end].strip(_BLANK):
            out.append(piece)
        if end >= n:
            return out
        at = max(end - overlap, at + 1)


# Languages that are cut along their structure, by extension.
STRUCTURED = {
    ".bash": "bash", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".cxx": "cpp", ".dart": "dart", ".el": "elisp", ".elm": "elm", ".ex": "elixir", ".exs": "elixir",
    ".go": "go", ".h": "c", ".hpp": "cpp", ".html": "html", ".htm": "html", ".hxx": "cpp", ".java": "java", ".js": "javascript", ".json": "json", ".jsx": "javascript", ".kt": "kotlin",
    ".kts": "kotlin", ".lua": "lua", ".mli": "ocaml", ".ml": "ocaml", ".php": "php", ".py": "python", ".ql": "ql", ".rb": "ruby", ".res": "rescript", ".resi": "rescript", ".rs": "rust",
    ".scala": "scala", ".scss": "css", ".sh": "bash", ".sol": "solidity", ".swift": "swift", ".toml": "toml", ".ts": "typescript", ".tsx": "tsx", ".vue": "vue", ".yaml": "yaml", ".yml": "yaml",
    ".zig": "zig", ".zsh": "bash",
}
_DECLARED = re.compile(
    r"(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|inline|extern|unsafe|override|virtual|sealed|data|open|declare)\s+)*"
    r"(?:function\*?|class|interface|type|enum|namespace|module|mod|struct|trait|impl|union|record|object|contract|def|fn|func|fun|sub|const|let|var|static)\s+(?:\([^)]*\)\s*)?([\w$]+)"
)
_CALLABLE = re.compile(r"(?:[\w<>\[\],*&:~$ \t]+[ \t*&])?([A-Za-z_$][\w$]*)\s*\([^;{]*\)[^;{]*\{")
_CONTROL = frozenset("if for while switch catch return else do try with match foreach unless until elif".split())
_CLOSING = re.compile(r"[)\]}]|end\b|else\b|elif\b|except\b|finally\b|catch\b|fi\b|done\b|esac\b")


@dataclass
class Part:
    """A stretch of code: its characters, the name that it declares, the parts within it."""

    start: int
    end: int
    name: str | None = None
    parts: list[Part] = field(default_factory=list)

    def symbol(self) -> str | None:
        """Its own name, else the first name among its parts, else that of its only part."""
        named = next((p.name for p in self.parts if p.name), None)
        return self.name or named or (self.parts[0].symbol() if len(self.parts) == 1 else None)


def declared(line: str) -> str | None:
    s = line.strip()
    if m := _DECLARED.match(s):
        return m[1]
    m = _CALLABLE.match(s)
    return m[1] if m and m[1] not in _CONTROL and s.split("(", 1)[0].split()[0] not in _CONTROL else None


def _by_indent(lines: list[str], starts: list[int], lo: int, hi: int, deep: int) -> list[Part]:
    """Parts of the lines lo..hi: each begins at a line of the least indent that closes nothing."""
    filled = [i for i in range(lo, hi) if lines[i].strip()]
    if not filled or deep > 40:
        return []
    indents = {i: len(lines[i]) - len(lines[i].lstrip()) for i in filled}
    least = min(indents.values())
    heads = [i for i in filled if indents[i] == least and not _CLOSING.match(lines[i].strip())] or filled[:1]
    if heads[0] != filled[0]:
        heads.insert(0, filled[0])
    out = []
    for head, after in zip(heads, [*heads[1:], hi]):
        mine = [i for i in filled if head <= i < after]
        last = mine[-1]
        inner = [i for i in mine if indents[i] > least]
        below = _by_indent(lines, starts, inner[0], inner[-1] + 1, deep + 1) if inner else []
        out.append(Part(starts[head], starts[last] + len(lines[last]), declared(lines[head]), below))
    return out


def _by_syntax(lines: list[str], starts: list[int], body: list[ast.stmt]) -> list[Part]:
    out = []
    for node in body:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
        inner = [x for name in ("body", "orelse", "finalbody") for x in getattr(node, name, []) if isinstance(x, ast.stmt)]
        name = node.name if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else None
        out.append(Part(starts[first], starts[node.end_lineno - 1] + len(lines[node.end_lineno - 1]), name, _by_syntax(lines, starts, inner)))
    return [p for n, p in enumerate(out) if not n or p.start >= out[n - 1].end]


def outline(text: str, language: str) -> Part:
    """The tree of a file: Python's by its syntax, others' (and broken files') by indentation."""
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    parts = None
    if language == "python":
        try:
            parts = _by_syntax(lines, starts, ast.parse(text).body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return Part(0, len(text), None, _by_indent(lines, starts, 0, len(lines), 0) if parts is None else parts)


def code_text(text: str) -> str:
    """LF line ends, no blank lines at the ends, indentation as it is."""
    return re.sub(r"(?:\n[^\S\n]*)+$", "", re.sub(r"^(?:[^\S\n]*\n)+", "", text.replace("\r\n", "\n")))


def code_windows(text: str, size: int) -> list[str]:
    """Pieces of code of at most ``size`` characters without overlap; indentation stays."""
    text, out, at = code_text(text), [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            b = max(text.rfind("\n", 0, end + 1), text.rfind(" ", 0, end + 1))
            if b > at + int(0.6 * size):
                end = b
        if (piece := code_text(text[at:end])).strip():
            out.append(piece)
        at = max(end, at + 1)
    return out


def code_pieces(text: str, basename: str, size: int) -> list[tuple[str, str]]:
    """Pieces along a file's structure: a part within ``size`` is one; else neighbouring parts are put together
    as long as they fit, and one that is too large alone is cut by its own parts, or by windows.

    The section is the file and the names of the parts that a piece stands in, the last of them its own where
    it has one part. Languages without structure give nothing.
    """
    language = STRUCTURED.get(re.sub(r"^.*(?=\.)", "", basename).lower())
    if language is None:
        return []
    body = text.replace("\r\n", "\n")
    out: list[tuple[str, str]] = []

    def section(path: list[str]) -> str:
        return " · ".join([basename, *path])

    def within(path: list[str], name: str | None) -> list[str]:
        return path if not name or path[-1:] == [name] else [*path, name]

    def put(piece: str, path: list[str]) -> None:
        piece = code_text(piece)
        if piece.strip():
            out.extend((section(path), x) for x in ([piece] if len(piece) <= size else code_windows(piece, size)))

    def split(part: Part, path: list[str], whole: bool = False) -> None:
        inner = within(path, part.symbol())
        if len(code_text(body[part.start : part.end])) <= size or not part.parts:
            put(body[part.start : part.end], inner)
            return
        path = path if whole else inner  # a file that is cut goes by its own name
        groups: list[list[Part]] = []
        for p in part.parts:
            if groups and len(code_text(body[groups[-1][0].start : p.end])) <= size:
                groups[-1].append(p)
            else:
                groups.append([p])
        for n, group in enumerate(groups):
            if len(group) == 1 and group[0].end - group[0].start > size:
                split(group[0], path)
                continue
            # what stands between groups goes with both
            begin = groups[n - 1][-1].end if n else part.start
            end = groups[n + 1][0].start if n + 1 < len(groups) else part.end
            put(body[begin:end], within(path, group[0].symbol() if len(group) == 1 else None))

    split(outline(body, language), [], True)
    return out


def sections_of(path: Column, content: Column) -> Column:
    """array<struct<section, content>> of a Markdown document, before any cutting."""

    @F.pandas_udf(PIECE)
    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([[{"section": s, "content": b} for s, b in markdown_sections(t, (p or "").rsplit("/", 1)[-1]) if b] if isinstance(t, str) else [] for p, t in zip(paths, contents)])

    return run(path, content)


def pieces(path: Column, content: Column, size: int, overlap: int) -> Column:
    """array<struct<section, content>> of a document: by sections, structure or plain windows."""

    @F.pandas_udf(PIECE)
    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(paths, contents):
            if not isinstance(t, str) or not t.strip(_BLANK):
                out.append([])
                continue
            base = (p or "").rsplit("/", 1)[-1]
            if re.search(r"[^/]\.(?:md|mdx|markdown)$", (p or "").lower()):
                got = [(s, w) for s, body in markdown_sections(t, base) for w in windows(body, size, overlap)]
            else:
                got = code_pieces(t, base, size) or [(base, w) for w in windows(t, size, overlap)]
            out.append([{"section": s, "content": w} for s, w in got])
        return pd.Series(out)

    return run(path, content)


def chunk(documents: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(document_id, chunk_index, section, content, token_estimate, content_hash) of every document."""
    made = documents.select(F.col("id").alias("document_id"), F.posexplode(pieces(F.col("path"), F.col("content"), size, overlap)).alias("chunk_index", "piece"))
    c = F.col("piece.content")
    return made.select("document_id", "chunk_index", F.col("piece.section").alias("section"), c.alias("content"), T.estimate_tokens(c).alias("token_estimate"), T.content_hash(c).alias("content_hash"))


def joined(parts: list[str], least: int = 8) -> str:
    """Pieces in order; where one ends as the next begins, over ``least`` characters or more, that stands once.

    The longest overlap counts. Only places where the next piece's first characters stand are tried.
    """
    text = ""
    for part in parts:
        if not text or not part:
            text = part if not text else text + "\n\n"
            continue
        at = text.find(part[:least], max(0, len(text) - len(part))) if len(part) >= least else -1
        while at >= 0 and not part.startswith(text[at:]):
            at = text.find(part[:least], at + 1)
        text = text + "\n\n" + part if at < 0 else text[:at] + part
    return text


def stitch(chunks: DataFrame, least: int = 8) -> DataFrame:
    """(document_id, content): chunks joined in order; an overlap of ``least`` or more is written once."""

    @F.pandas_udf("string")
    def run(many: pd.Series) -> pd.Series:
        return pd.Series([joined([p or "" for p in parts], least) for parts in many], dtype=object)

    ordered = chunks.groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("chunk_index", "content"))).alias("parts"))
    return ordered.select("document_id", run(F.transform("parts", lambda x: x["content"])).alias("content"))


def hydrate(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose content is null get their chunks stitched together."""
    missing = documents.where("content is null or content = ''").select(F.col("id").alias("document_id"))
    stitched = stitch(chunks.join(missing, "document_id", "left_semi")).withColumnRenamed("content", "stitched")
    joined = documents.join(stitched, documents["id"] == stitched["document_id"], "left")
    return joined.withColumn("content", F.coalesce("content", "stitched", F.lit(""))).select(documents.columns)


def migrate_v3_to_v4(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The older layout has no content column: it is rebuilt from the chunks."""
    return hydrate(documents.withColumn("content", F.lit(None).cast("string")), chunks)
