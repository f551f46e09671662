"""Template residue, filler, error pages and script notices instead of content.

Method: normalised lines are counted by host (web pages) or source (files); lines that recur there
are boilerplate and are subtracted, as are the page's own furniture blocks. What is left, the
residual, decides: a record whose residual is mostly error, placeholder, filler or script-required
evidence holds no content. Evidence is a whole sentence or line in such a form, so that text that
only mentions or quotes it stays a small part of its residual.

Defined results for odd input: null, empty or blank text is no case; program code and settings
files are no cases; rows delivered twice give one row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boilerplate import furniture, host_of, normal
from .common import CODE_SUFFIXES, cut

# Words of the classical filler text.
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque vivamus praesent".split()
)

# Notices in the form in which servers, browsers, templates and site builders print them.
_NOTICES = [
    # scripts required
    r"(?:please |you (?:must|need to) )?(?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts|cookies)\b.{0,90}",
    r".{0,60}\b(?:needs|requires|works only with|won't work without|doesn't work without|does not work without|relies on|depends on) (?:java ?script|scripts)\b.{0,60}",
    r".{0,40}\b(?:scripts?|java ?script) (?:is|are|has been|must be) (?:switched off|turned off|disabled|off|required|blocked|not (?:enabled|available|supported))\b.{0,60}",
    r"(?:switch|turn) (?:java ?script|scripts) (?:back )?on\b.{0,60}|(?:switch|turn) on (?:java ?script|scripts)\b.{0,60}",
    r"browser support code\b.{0,20}",
    r"(?:bitte )?(?:aktivieren|schalten) sie (?:bitte )?java ?script\b.{0,70}",
    r"(?:veuillez )?(?:activez|activer) java ?script\b.{0,70}",
    r"(?:por favor,? )?(?:habilite|active|activa|ative) (?:o )?java ?script\b.{0,70}",
    r"(?:si prega di )?(?:attivare|abilita|abilitare|attiva) java ?script\b.{0,70}",
    r"(?:schakel|zet) java ?script (?:in|aan)\b.{0,70}",
    r"请(?:先)?(?:启用|开启|打开|允许).{0,4}java ?script.{0,30}|本(?:站|页面)需要.{0,6}(?:java ?script|脚本).{0,20}",
    # errors
    r"(?:error |http |status |erreur |fehler |errore |fout |erro )*(?:[45]\d\d)(?:[ :.–-]+(?:not found|page not found|forbidden|unauthorized|bad gateway|bad request|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|gone|method not allowed))?",
    r"(?:error|erreur|fehler|errore|erro) [45]\d\d ?[:–-] ?.{0,100}",
    r"(?:the )?page not found\b.{0,80}|not found|the requested (?:url|page|resource) .{0,80}(?:not found|does not exist|could not be found).{0,40}",
    r"the page \S{1,80} (?:does not exist|was not found|could not be found|has (?:been )?moved).{0,40}",
    r"(?:oops|sorry|uh-?oh|whoops)[!,. ]{1,3}(?:we (?:could not|couldn't|can't|cannot) find|(?:this|that|the) page|something went wrong|nothing here)?.{0,80}",
    r"we (?:could not|couldn't|can't|cannot) find (?:/\S+|(?:the|that|this) page\b.{0,60})",
    r"return to the home ?page|go back (?:to the )?home(?: ?page)?|back to (?:the )?(?:home ?page|start)",
    r"(?:seite|datei|dokument) nicht gefunden\b.{0,40}|die (?:adresse|seite) \S{1,80} (?:gibt es nicht|existiert nicht|wurde nicht gefunden).{0,30}",
    r"(?:la )?page (?:est )?(?:introuvable|non trouvée)\b.{0,60}|la page \S{1,80} (?:est introuvable|n'existe pas).{0,40}",
    r"(?:página|pagina) (?:no encontrada|não encontrada|non trovata|niet gevonden)\b.{0,80}|(?:vuelva|volver|voltar|volte|torna|terug) (?:al|a la|ao|à|alla|naar(?: de)?) (?:inicio|início|página inicial|home|startpagina|pagina iniziale)",
    r"(?:页面|网页|您访问的页面)(?:不存在|未找到|找不到).{0,60}",
    r"access (?:is )?denied\b.{0,40}|(?:403 )?forbidden|unauthorized|you (?:do not|don't) have (?:permission|access|the rights?) .{0,80}|permission denied\b.{0,40}|request id:? \w{6,40}",
    r"(?:an? )?(?:internal )?(?:server )?error (?:has )?occurred.{0,60}|something went wrong\b.{0,60}|incident \w{4,20}|an? (?:unexpected|unknown|fatal|application) error\b.{0,60}",
    r"(?:\d{3} )?(?:bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|bad request|request time-?out)",
    r"upstream \S+ (?:gave no answer|did not answer|timed out|is unreachable).{0,30}|(?:nginx|ngate|apache|openresty|cloudflare|caddy|lighttpd|varnish|iis)(?:/[\d.]+)?(?: \(\w+\))?",
    r"slow down and come back (?:after|in) .{0,30}|try again (?:in|after|later)\b.{0,40}|reference:? [0-9a-f]{6,40}|rate limit exceeded.{0,40}",
    r"(?:the |our )?(?:site|service|server|page|system|application|\S+) is (?:currently |temporarily )?(?:down|unavailable|offline|overloaded|under maintenance|being updated|in maintenance)\b.{0,60}|(?:down for |scheduled )maintenance.{0,40}|we(?:'ll| will) be back (?:soon|shortly).{0,30}",
    r"(?:your |the )?session (?:has |is )?(?:expired|ended|timed out).{0,40}|(?:sign|log) in (?:to \S+ )?to (?:continue|view|read|see)\b.{0,40}|please (?:sign|log) in\b.{0,60}|you (?:must|need to) (?:be logged in|(?:sign|log) in)\b.{0,60}",
    r"(?:checking|verifying) (?:your browser|that you are human|if the site connection is secure|you are human)\b.{0,80}|ray id:? \w+|code [0-9a-f]{6,20}|(?:are you|verify you are|prove you are) (?:a )?(?:human|robot)\b.{0,40}|complete the captcha.{0,40}|just a moment\b.{0,10}",
    r"(?:this |the )?domain(?: name)? \S{3,80} (?:is|has been) (?:parked|for sale|expired|registered).{0,60}|(?:it|this domain) (?:may|might|could) be for sale\b.{0,40}|buy this domain\b.{0,40}|parked (?:domain|free).{0,60}",
    r"traceback \(most recent call last\):?|file \"[^\"]{1,160}\", line \d+.{0,60}|\w*(?:error|exception)(?:: .{0,140})?|at [\w.$<>]+\([\w./:-]*\)|(?:warning|fatal error|parse error|notice): .{0,140} on line \d+|line \d+, in .{1,60}|return self\.\w+\(.{0,80}\)|(?:in )?<module>",
    # placeholders and half-made pages
    r"coming soon\b.{0,40}|(?:\S+ |this (?:page|site|section) )?(?:is |still )?under construction\b.{0,30}|(?:come|check) back (?:later|soon)\b.{0,20}|watch this space.{0,10}|demnächst(?: verfügbar)?|bientôt(?: disponible)?|próximamente|em breve|prossimamente|binnenkort.{0,20}|敬请期待.{0,10}|(?:网站|页面)?(?:正在)?建设中.{0,10}",
    r"t\.?b\.?[dac]\.?|todo:? ?(?:write|add|fill|describe|insert|document|complete|finish).{0,60}|todo|to be (?:written|done|determined|announced|completed|added)\b.{0,20}|wip|work in progress\b.{0,20}",
    r"\(?(?:content|text|description|image|title) (?:goes|comes) here\)?|(?:your |sample |dummy |placeholder |insert )(?:text|content|copy|title|image|heading)(?: here| goes here| for layout only| only)?|this is (?:a |some )?(?:placeholder|sample|dummy|filler|example)(?: (?:text|page|paragraph|content))?|add (?:a|your|an?) (?:subheading|heading|title|description|text|image|caption|paragraph)\b.{0,30}|click (?:here )?to (?:edit|add|change)\b.{0,40}|replace this (?:with|text)\b.{0,40}|edit this (?:paragraph|text)\b.{0,20}",
    r"hello,? world!?|welcome to wordpress\b.{0,60}|this is your first post\b.{0,40}|just another \w+ site",
    r"(?:undefined|null|nan|none|\[object object\]|invalid date)(?:[ ,:;|/·-]+(?:undefined|null|nan|none|\[object object\]|invalid date|by|on))*|nan \S{1,30}|\S{1,30}: (?:undefined|null|nan|\[object object\])|(?:posted|written|updated|published)(?: by)? (?:null|undefined|nan)(?: on (?:invalid date|null|undefined|nan))?",
]
_NOTICE = re.compile(r"(?:" + "|".join(f"(?:{x})" for x in _NOTICES) + r")[.!。！]?", re.I)
_SLOT = re.compile(
    r"\{\{[^{}]{1,120}\}\}|\{%[^%]{1,120}%\}|<%[^%]{1,120}%>|\$\{[^{}]{1,80}\}|%\([\w.]+\)[sd]|%[A-Z][A-Z0-9_]+%|\[\[[\w .-]{1,60}\]\]|__[A-Z][A-Z0-9_]*__|(?<![\w$])\$[A-Z][A-Z0-9_]{2,}\b|@@?[A-Z_]{3,}@@?|@@[\w.]{2,60}@@|%%[\w.]{2,60}%%|##[\w.]{2,60}##|<<[\w. ]{2,60}>>|#\{[\w.]{1,60}\}|\{\$[\w.]{1,60}\}|\{[a-z_]{2,40}(?:\.[a-z_]{1,40})*\}"
    r"|\[(?:insert|your|product|company|section|describe|add|title|name|date|name of|enter|placeholder|author|client|city|email|phone|address|logo|image|link|topic|number)\b[^\[\]()]{0,90}\](?!\()",
    re.I,
)
_CASED_SLOT = re.compile(r"__[A-Z][A-Z0-9_]*__|\$[A-Z][A-Z0-9_]{2,}|%[A-Z][A-Z0-9_]+%")
_ENDS = re.compile(r"(?<=[.!?。！？])(?:\s+|(?<=[。！？]))|\s*¶\s*")
_DECOR = re.compile(r"^[\s#>*+\-_=|`~]+|[\s*_`|]+$")
_WORD = re.compile(r"[^\W\d_]+")
# Every form above contains one of these in lower case (tests hold each alternative against them); lines without any aren't looked at.
_SIGNS = (
    "script", "cookies", "browser support", "脚本", "not found", "not be found", "couldn't find", "does not exist", "was not found", "moved", "oops", "sorry", "uh-oh", "uhoh", "whoops", "could not find", "can't find",
    "cannot find", "home page", "homepage", "to home", "to the home", "back to", "go back", "nicht gefunden", "gibt es nicht", "existiert nicht", "introuvable", "non trouvée", "n'existe pas", "no encontrada", "não encontrada", "non trovata",
    "niet gevonden", "inicio", "início", "página inicial", "startpagina", "pagina iniziale", "al home", "ao home", "alla home", "à home", "terug naar", "不存在", "未找到", "找不到", "denied", "forbidden", "unauthorized",
    "you do not have", "you don't have", "request id", "error", "erreur", "fehler", "fout", "erro ", "went wrong", "incident ", "bad gateway", "gateway time", "unavailable", "too many requests", "bad request", "request time", "upstream ",
    "nginx", "ngate", "apache", "openresty", "cloudflare", "caddy", "lighttpd", "varnish", "iis", "slow down", "try again", "reference", "rate limit", " is down", " is offline", " is overloaded", "currently ", "temporarily ", "maintenance",
    "being updated", "be back", "session", "sign in", "log in", "logged in", "checking", "verifying", "ray id", "code ", "human", "robot", "captcha", "just a moment", "domain", "for sale", "parked", "traceback", "file \"", "exception",
    "at ", "warning: ", "fatal", "notice: ", "line ", "return self", "module>", "coming soon", "under construction", "back later", "back soon", "watch this space", "demnächst", "bientôt", "próximamente", "em breve", "prossimamente",
    "binnenkort", "敬请期待", "建设中", "tb", "t.b", "todo", "to be ", "wip", "work in progress", "goes here", "comes here", "your ", "sample ", "dummy ", "placeholder", "insert ", "filler", "example", "add a", "add your", "click ", "replace this",
    "edit this", "hello", "welcome to", "first post", "just another", "undefined", "null", "nan", "none", "[object object]", "invalid date",
    "lorem", "ipsum", "dolor", "amet", "{{", "{%", "<%", "${", "%(", "[[", "__", "@@", "%%", "##", "<<", "#{", "{$", "{_", *(m + c for m in "{$%@" for c in "abcdefghijklmnopqrstuvwxyz"),
    *("[" + w for w in "insert your product company section describe add title name date enter placeholder author client city email phone address logo image link topic number".split()),
    *(str(n) for n in range(400, 600)),
)


@functools.cache
def _spotter() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for sign in _SIGNS:
        found.add_word(sign)
    found.make_automaton()
    return found


def evident(text: str) -> dict[int, int]:
    """Characters of evidence by number of line, of the lines that have any."""
    ends: list[int] | None = None
    seen, out = -1, {}
    low = text.lower()
    lines: list[str] = []
    for end, _ in _spotter().iter(low):
        if ends is None:
            lines = text.split("\n")
            ends = list(accumulate(len(x) + 1 for x in low.split("\n")))
        if end < (ends[seen] if seen >= 0 else 0):
            continue
        seen = bisect_right(ends, end)
        if n := evidence(lines[seen]):
            out[seen] = n
    return out


#: Characters of the longest sentence that a notice is taken for.
SENTENCE = 400


def evidence(line: str) -> int:
    """Characters of a line that are evidence: notices, unfilled slots and filler."""
    s = _DECOR.sub("", line)
    if not s:
        return 0
    slots = sum(len(m) for m in _SLOT.findall(s) if m.startswith("${") or m[0] not in "$_%" or m[:2] in ("%(", "%%") or _CASED_SLOT.fullmatch(m)) if any(c in s for c in "{[<$%_@#") else 0
    if slots and "`" not in line and slots >= 0.4 * len(s):
        return len(s)
    words = _WORD.findall(s.lower())
    if len(words) >= 6 and sum(w in _LOREM for w in words) >= 0.6 * len(words):
        return len(s)
    if '"' in s[:1]:
        return 0
    if len(s) <= SENTENCE and _NOTICE.fullmatch(s):
        return len(s)
    parts = [p for p in _ENDS.split(s) if p]
    if len(parts) < 2:
        return 0
    return sum(len(p) for p in parts if len(p) <= SENTENCE and _NOTICE.fullmatch(p.strip()))


def verdict(text: str, host: str | None, title: str | None, boilerplate: set[int] | frozenset[int] = frozenset(), share: float = 0.5) -> bool:
    """Whether a record's residual is mostly evidence; boilerplate: numbers of its recurrent lines."""
    text = text.replace("\r", "")
    lines, seen = text.split("\n"), evident(text)
    if not seen:
        return False
    found = [seen.get(i, 0) for i in range(len(lines))]
    votes = [2 if i in boilerplate and not found[i] else 0 for i in range(len(lines))]
    if host:
        bad = furniture(lines, host, title, votes, 1)
    else:
        bad = [v > 0 for v in votes]
    total = got = 0
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or (bad[i] and not found[i]):
            continue
        if not found[i] and (s.startswith("#") or s.startswith("```") or not any(c.isalnum() for c in s)):
            continue
        # furniture that happens to read like a notice counts on neither side
        if bad[i] and found[i] < len(_DECOR.sub("", line)):
            continue
        total += len(s)
        got += min(len(s), found[i] + len(s) - len(_DECOR.sub("", line)))
    return got > 0 and got >= share * total


def _recurrent(rows: DataFrame, least: int, share: float) -> DataFrame:
    """(place, line) hashes of the normalised lines that recur in a place's records."""
    sizes = rows.groupBy("place").agg(F.countDistinct("id").alias("records"))
    lines = rows.select("place", "id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(F.regexp_replace(F.lower(F.trim(x)), r"\d+", "0"))))).alias("line"))
    counts = lines.groupBy("place", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(sizes, "place").where(F.col("n") >= share * F.col("records")).select("place", "line")


def residue(rows: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """(id) of the records without content; rows: id, place, host, title, text."""

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[isinstance(t, str) and bool(evident(t)) for t in b["text"]]]

    clean = rows.where("id is not null and text is not null").withColumn("text", F.regexp_replace("text", "\r", ""))
    candidates = cut(clean.mapInPandas(signs, clean.schema))  # read twice below
    marked = candidates.withColumn("line", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(F.regexp_replace(F.lower(F.trim(x)), r"\d+", "0"))))))
    known = marked.select("id", "place", "line").join(_recurrent(clean, least, share), ["place", "line"]).groupBy("id").agg(F.collect_set("line").alias("known"))
    judged = candidates.join(known, "id", "left").withColumn(
        "known", F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.array_contains("known", F.xxhash64(F.regexp_replace(F.lower(F.trim(x)), r"\d+", "0"))), i)), lambda i: i.isNotNull())
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [verdict(t, h, n, frozenset() if k is None else frozenset(k)) for t, h, n, k in zip(b["text"], b["host"], b["title"], b["known"])]
            yield b.loc[keep, ["id"]]

    return judged.select("id", "host", "title", "text", "known").mapInPandas(decide, "id long").distinct()


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.regexp_replace("final_url", "^([^/]*//)[^/@]*@", "$1"), r"^[^/]*//([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), F.coalesce(host, F.lit("")).alias("place"), F.coalesce(host, F.lit("")).alias("host"), F.col("title").cast("string").alias("title"), F.col("markdown").alias("text"))


def document_rows(documents: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    settings = ("toml", "json", "yaml", "yml", "ini", "env", "properties", "cfg", "conf", "lock", "xml")
    prose = documents.where(~F.coalesce(suffix, F.lit("")).isin(*CODE_SUFFIXES, *settings))
    host = F.when(F.col("source_kind") == "web", F.lower(F.regexp_extract("source_locator", r"^[^/]*//([^/?#]*)", 1)))
    return prose.select(F.col("id").cast("long").alias("id"), F.coalesce("source_key", F.lit("")).alias("place"), F.coalesce(host, F.lit("")).alias("host"), F.col("title").cast("string").alias("title"), F.col("content").alias("text"))


def bad_pages(pages: DataFrame) -> DataFrame:
    return residue(page_rows(pages)).withColumnRenamed("id", "page_id")


def found(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_table, record_id) of the records of both tables that hold no content."""
    web = residue(page_rows(pages)).select(F.lit("web_fetched_pages").alias("record_table"), F.col("id").alias("record_id"))
    files = residue(document_rows(documents)).select(F.lit("kb_documents").alias("record_table"), F.col("id").alias("record_id"))
    return web.unionByName(files)


__all__ = ["bad_pages", "evidence", "found", "host_of", "normal", "residue", "verdict"]
