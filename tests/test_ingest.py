import json
import stat
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata import commands, evaluation
from lodestrata.functions import redaction as X
from lodestrata.functions.embedding import Fingerprint, HashedEmbedder, KeywordEmbedder, ServiceEmbedder, query_task
from lodestrata.operators import crawl, evidence, lookup, structured
from lodestrata.operators.ingest import Learner, NothingLearned
from lodestrata.operators.store import DOCUMENTS, Store
from lodestrata.progress import Progress
from lodestrata.session import numbered
from lodestrata.sources import files, policies, webpages

E = KeywordEmbedder(("harbour", "crane", "rope"))
SITE = "https://port.example/guide/"


def record(url, text, *links):
    return {"url": url, "markdown": {"raw_markdown": text}, "metadata": {"title": url.rsplit("/", 1)[-1] or "Home"}, "links": {"internal": [{"href": x} for x in links[::2]], "external": list(links[1::2])}}


PAGES = {
    SITE: record(SITE, "# Port\nthe harbour " * 20, "ropes", "https://else.example/x", "cranes#top", "https://port.example/guide/ropes?token=1", "/guide/logo.png", "https://port.example/other/"),
    SITE + "ropes": record(SITE + "ropes", "# Ropes\nrope " * 20, "deep"),
    SITE + "deep": record(SITE + "deep", "# Deep\nrope " * 20, "deeper"),
    SITE + "deeper": record(SITE + "deeper", "# Deeper\nrope " * 20),
}


def commit(folder, **texts):
    folder.mkdir(parents=True, exist_ok=True)
    subprocess.run(["git", "init", "-q"], cwd=folder, check=True)
    for name, text in texts.items():
        (folder / name.replace("__", ".")).write_text(text)
    subprocess.run(["git", "add", "-A"], cwd=folder, check=True)
    subprocess.run(["git", "-c", "user.email=a@b.c", "-c", "user.name=a", "commit", "-qm", "x"], cwd=folder, check=True)
    return str(folder)


def learner(spark, folder, **more):
    return Learner(spark, Store(spark, str(folder / "index")), E, lambda: "now", cache=str(folder / "cache"), **more)


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(f"k{n % 7}", n) for n in range(100)], "k string, v int").repartition(5)
    got = sorted(tuple(r) for r in numbered(df, ["k", "v"], 11).select("id", "k", "v").collect())
    assert [r[0] for r in got] == list(range(11, 111)) and [r[1:] for r in got] == sorted(r[1:] for r in got)
    assert numbered(df.where("false"), ["k"], 1).count() == 0


def test_learning_a_repository(spark, tmp_path):
    at = commit(tmp_path / "r", a__md="# A\nthe crane", b__py="def f():\n    return 'rope'\n", c__lock="x")
    l = learner(spark, tmp_path)
    got = l.learn_git(at)
    assert (got.documents, got.chunks, got.skipped, got.failures) == (2, 2, {"ignored": 1}, [])
    rows = {r["path"]: r for r in l.store.documents.collect()}
    assert rows["a.md"]["source_key"] == at and rows["b.py"]["source_locator"] == f"{at}/b.py" and sorted(r["id"] for r in rows.values()) == [1, 2]
    assert [r["path"] for r in l.store.search("rope", E.embed_query("rope"), 1).collect()] == ["b.py"]
    (tmp_path / "r" / "a.md").unlink()
    again = l.learn_git(at)
    assert again.documents == 1 and [f["path"] for f in again.failures] == ["a.md"] and [r["id"] for r in l.store.documents.collect()] == [3]
    (tmp_path / "r" / "b.py").unlink()
    (tmp_path / "r" / "c.lock").unlink()
    with pytest.raises(NothingLearned):
        l.learn_git(at)
    assert l.store.documents.count() == 0 and l.store.manifests.count() == 1


def test_learning_a_remote_repository(spark, tmp_path):
    at = commit(tmp_path / "r", a__md="# A\nthe crane")
    l = learner(spark, tmp_path)
    assert l.learn_git(f"file://{at}").documents == 1
    commit(tmp_path / "r", d__md="# D\nthe rope")
    assert l.learn_git(f"file://{at}").documents == 2
    m = l.store.manifests.first()
    assert m["source_kind"] == "remote_git" and json.loads(m["reingest_payload_json"]) == {"kind": "git", "source": f"file://{at}"}
    assert files.network_url("https://u:p@h.example/r.git?token=1&x=2#f") == "https://h.example/r.git?x=2" and files.network_url("ssh://git@h.example/r") == "ssh://git@h.example/r"


def test_crawling_a_site(spark):
    pages, failures = crawl.crawl(spark, SITE, webpages.RecordedPages(PAGES), max_pages=10, max_depth=3, retries=1)
    got = [(r["position"], r["url"].removeprefix(SITE), r["depth"], r["attempts"]) for r in pages.orderBy("position").collect()]
    assert got == [(1, "", 0, 1), (2, "ropes", 1, 1), (3, "deep", 2, 1)]
    assert sorted((r["url"].removeprefix(SITE), r["reason"], r["attempts"]) for r in failures.collect()) == [("cranes", "fetch_error", 2), ("ropes?token=[REDACTED]", "fetch_error", 2)]
    pages, _ = crawl.crawl(spark, SITE, webpages.RecordedPages(PAGES), max_pages=2, max_depth=9, retries=0)
    assert sorted(r["url"].removeprefix(SITE) for r in pages.collect()) == ["", "ropes"]
    none, _ = crawl.crawl(spark, "https://port.example/static/x", webpages.RecordedPages({}), max_pages=2)
    assert none.count() == 0


def test_learning_a_site(spark, tmp_path):
    l = learner(spark, tmp_path, pages=webpages.RecordedPages(PAGES), retries=0)
    got = l.learn_web(SITE + "#top", crawling=True, max_pages=5, max_depth=2)
    assert got.documents == 2 and len(got.failures) == 2 and got.source_key == SITE
    assert sorted(r["path"] for r in l.store.documents.collect()) == [SITE, SITE + "ropes"]
    # without a page old rows stay
    l.pages = webpages.RecordedPages({SITE: {"error": "request timed out"}})
    with pytest.raises(NothingLearned) as e:
        l.learn_web(SITE)
    assert [f["reason"] for f in e.value.failures] == ["timeout"] and l.store.documents.count() == 2
    l.pages = webpages.RecordedPages({SITE: record(SITE, " \n ")})
    with pytest.raises(NothingLearned):
        l.learn_web(SITE, mode="get")
    assert l.store.documents.count() == 2


def test_rebuilding_what_is_recorded(spark, tmp_path):
    l = learner(spark, tmp_path, pages=webpages.RecordedPages(PAGES), retries=0)
    assert l.ensure() == {"rebuilt": True, "reason": "index bootstrap required"} and l.ensure() == {"rebuilt": False, "reason": None}
    at = commit(tmp_path / "r", a__md="# A\nthe crane")
    l.learn_git(at)
    l.learn_web(SITE)
    l.embedder = KeywordEmbedder(("harbour",))
    assert l.ensure() == {"rebuilt": True, "reason": "embedding fingerprint changed"}
    assert l.store.documents.count() == 2 and {len(r["embedding"]) for r in l.store.chunks.collect()} == {1}
    assert {r["last_rebuild_status"] for r in l.store.manifests.collect()} == {"success"}
    l.pages = webpages.RecordedPages({})
    done = l.rebuild(retry=1)
    assert done["rebuilt"] == [at] and done["failed"] == [SITE] and l.store.manifests.where(f"source_key = '{SITE}'").first()["last_rebuild_attempts"] == 2
    with pytest.raises(RuntimeError, match="rebuilding failed"):
        l.ensure()
    l.pages = webpages.RecordedPages(PAGES)
    assert l.rebuild(failed_only=True)["rebuilt"] == [SITE] and l.store.documents.count() == 2
    with pytest.raises(ValueError):
        l.reingest({"source_key": "x", "reingest_payload_json": "{}"})


def test_replies_of_crawlers(spark):
    assert webpages.json_from_output('INFO start\n[{"url": "u"}]\ndone') == [{"url": "u"}] and webpages.as_records({"a": 1}) == [{"a": 1}]
    for bad in ("", "no json", "{ broken", "} {"):
        with pytest.raises(ValueError, match="json"):
            webpages.json_from_output(bad)
    rows = [("https://h.example/a/", json.dumps(r)) for r in (
        {"markdown": "m", "url": " ", "metadata": {"url": "HTTPS://H.example/b#f", "title": " T "}, "links": {"internal": ["c", {"href": "../d#x"}, {"no": 1}], "external": ["mailto:a@b.c"]}},
        {"markdown": {"fit_markdown": "fit"}, "title": "own", "links": "none"}, {"markdown": 5, "raw_markdown": "raw"}, {"markdown": {"raw_markdown": "", "fit_markdown": "x"}},
    )]
    got = [tuple(r) for r in webpages.page_fields(spark.createDataFrame([*rows, ("https://h.example", "no record")], "asked string, record string")).collect()]
    a = "https://h.example/a/"
    assert got == [
        (a, "https://h.example/b", "T", "m", ["https://H.example/c", "https://H.example/d"]), (a, a, "own", "fit", []), (a, a, a, "raw", []), (a, a, a, "", []), ("https://h.example", "https://h.example/", "https://h.example", "", []),
    ]


def test_paged_crawl_jobs(spark):
    calls = []

    def call(path, body):
        calls.append((path, body))
        if path == "/crawl":
            return {"success": True, "result": "job" + str(body["render"])}
        if body.get("limit") == 1 and "cursor" not in body and len([c for c in calls if c[0] == path]) < 3:
            return {"success": True, "result": {"status": "running" if len([c for c in calls if c[0] == path]) == 1 else "completed"}}
        if path == "/crawl/jobFalse":
            return {"success": True, "result": {"records": [{"status": "errored", "url": "https://h.example/x", "metadata": {"status": 500}}], "cursor": None}}
        first = {"records": [{"status": "completed", "url": "https://h.example/a", "markdown": "text"}, {"status": "completed", "url": "https://h.example/a", "markdown": "again"}], "cursor": 2}
        rest = {"records": [{"status": "skipped", "url": "https://h.example/b"}, {"status": "completed", "url": "https://h.example/c", "markdown": " "}, {"status": "completed", "url": "https://h.example/d", "markdown": "d"}], "cursor": 3}
        return {"success": True, "result": rest if "cursor" in body else first}

    pages, failures = webpages.ServicePages(call, sleep=lambda ms: None).crawl(spark, "https://h.example/", 4, 2)
    assert [(r["url"], r["markdown"]) for r in pages.collect()] == [("https://h.example/a", "text")]
    assert sorted((r["url"], r["reason"]) for r in failures.collect()) == [("https://h.example/b", "skipped"), ("https://h.example/c", "empty")]
    assert [b for p, b in calls if p == "/crawl/jobTrue"][-2:] == [{"limit": 4}, {"limit": 2, "cursor": 2}]
    with pytest.raises(RuntimeError, match="refused"):
        webpages.ServicePages(lambda p, b: {"success": False}).fetch("u", "get")


def test_a_crawler_program(tmp_path):
    program = tmp_path / "crawler"
    program.write_text('#!/bin/sh\n[ "$1" = --help ] && exit 0\necho "note"\necho "[{\\"url\\": \\"$2\\", \\"markdown\\": \\"x\\"}]"\n')
    program.chmod(program.stat().st_mode | stat.S_IEXEC)
    source = webpages.page_source("command", str(program))
    source.check()
    assert source.fetch("https://h.example/", "get") == {"url": "https://h.example/", "markdown": "x"}
    with pytest.raises(RuntimeError):
        webpages.CommandPages(str(tmp_path / "none")).check()
    with pytest.raises(ValueError):
        webpages.page_source("carrier pigeon")


def test_fetch_modes_and_retries(spark):
    def fetch(mode, least=200, retries=0, text="short", fails=0):
        u = "https://h.example/"
        return webpages.fetch_pages(spark.createDataFrame([(u,)], "url string"), webpages.RecordedPages({u: {"markdown": text}}, {u: fails}), mode, retries, 0, least).first()

    assert json.loads(fetch("auto")["record"]) == {"markdown": "short"} and fetch("get", text="")["error"].startswith("content too short (0")
    assert (fetch("fetch", retries=2, fails=2)["attempts"], fetch("fetch", retries=1, fails=2)["error"]) == (3, "network: https://h.example/ failed")
    with pytest.raises(ValueError):
        fetch("slow")


def test_rate_limits_and_retries():
    clock = [0.0]
    slept = []

    def sleep(ms):
        slept.append(ms)
        clock[0] += ms

    gate = policies.RateGate(60, lambda: clock[0], sleep)
    for _ in range(3):
        gate.acquire(1)
    gate.acquire(0)
    assert slept == [1000, 1000]
    assert policies.retry_after_ms("7", 0) == 7000 and policies.retry_after_ms("Thu, 01 Jan 1970 00:00:09 GMT", 4000) == 5000 and policies.retry_after_ms("soon", 0) is None and policies.retry_after_ms(None, 0) is None
    assert (policies.retry_delay_ms(429, None, 10), policies.retry_delay_ms(500, 50, 10), policies.retry_delay_ms(None, None, -5)) == (20, 50, 0)
    for replies, retries, calls, status in (([503, 200], 1, 2, 200), ([429] * 9, 1, 4, 429), ([404], 3, 1, 404), ([500, 500], 0, 1, 500)):
        left = list(replies)
        call = policies.with_policies(lambda u, b: policies.Response(left.pop(0)), retries=retries, delay_seconds=0, now=lambda: clock[0], sleep=sleep)  # noqa: B023
        assert call("u").status == status and len(replies) - len(left) == calls

    def broken(u, b):
        raise ConnectionError("reset") if u == "net" else KeyError("bug")

    for u, error in (("net", ConnectionError), ("x", KeyError)):
        with pytest.raises(error):
            policies.with_policies(broken, retries=1, delay_seconds=0, sleep=sleep)(u)


def test_structured_replies_and_usage():
    refusals = [structured.ModelError("JSON mode isn't there", 400), structured.ModelError("no object", body="response_format", no_object=True)]
    for error in refusals:
        m = structured.ServiceModel(lambda s, p: (_ for _ in ()).throw(error), lambda s, p: ('Sure:\n```json\n{"queries": ["a"]}\n```', {"input": 5, "output": 2, "total": 7}))  # noqa: B023
        assert m.plan("q", []) == {"queries": ["a"]} and m.fell_back and m.usage.total == 7 and not m.usage.estimated
    plain = structured.ServiceModel(lambda s, p: ({"answer": "x"}, None), None)
    assert plain.answer("q", ["e"], []) == {"answer": "x"} and plain.usage.estimated and plain.usage.total > 0 and plain.usage.by_kind == {"answer": 1}
    for error in (structured.ModelError("json mode", 500), structured.ModelError("quota", 400), ValueError("json mode")):
        assert not structured.needs_text(error)
    inner, outer = structured.ModelError("x", 400), structured.ModelError("y", 406)
    outer.__cause__, inner.__cause__ = inner, outer
    inner.body = "unsupported"
    assert structured.needs_text(outer)
    with pytest.raises(ValueError):
        structured.model("oracle")
    assert isinstance(structured.model("scripted", [{}], [{}]), evidence.Scripted)


def test_progress():
    said = []
    p = Progress(said.append)
    t = p.start("read", 2)
    p.add(t)
    p.stop(t)
    m = structured.ServiceModel(lambda s, q: ({}, {"input": 3, "output": 1, "total": 4}), None, progress=p)
    m.plan("q", [])
    m.plan("q", [])
    assert said == ["read: 0/2", "read: 1/2", "read: 1/2 done", "tokens: 4", "tokens: 8"] and not p.estimated
    Progress().start("silent")


def test_embedders(spark):
    h = HashedEmbedder(8)
    df = spark.createDataFrame([("rope and rope",), ("",), (None,)], "c string")
    rows = [r[0] for r in df.select(h.embed(F.col("c"))).collect()]
    assert h.embed_query("rope and rope") == rows[0] and rows[1] == [0.0] * 8
    f = Fingerprint("service", "m", 2, "RETRIEVAL_DOCUMENT", "1", "structure")
    s = ServiceEmbedder(lambda texts, task: [[float(len(t)), 1.0 if task == "RETRIEVAL_QUERY" else 0.0] for t in texts], f, size=1)
    assert [r[0] for r in df.select(s.embed(F.col("c"))).collect()] == [[13.0, 0.0], [0.0, 0.0], [0.0, 0.0]] and s.embed_query("ab") == [2.0, 1.0] and query_task("CLUSTERING") == "CLUSTERING"
    with pytest.raises(ValueError, match="embed"):
        ServiceEmbedder(lambda texts, task: [[1.0]], f).embed_query("x")


def test_looking_documents_up(spark):
    row = lambda i, key, path: (i, key, "web", key, None, path, "markdown", "t", "h", f"text {i}", "now")
    d = spark.createDataFrame([row(1, "a", "src/x.py"), row(2, "b", "src/x.py"), row(3, "a", "https://h.example/?token=[REDACTED]")], DOCUMENTS)
    assert lookup.get(d, path=".\\src\\x.py".replace(".\\", "./"), source_key="b")["id"] == 2 and lookup.get(d, document_id=1)["content"] == "text 1"
    assert lookup.get(d, path="https://h.example?token=9")["id"] == 3 and X.lookup_path("./a\\b") == "a/b"
    for wrong, error in (({"path": "src/x.py"}, "several"), ({"path": "y"}, "no document at"), ({"document_id": 9}, "no document 9")):
        with pytest.raises(LookupError, match=error):
            lookup.get(d, **wrong)
    for wrong in ({}, {"path": "a", "document_id": 1}, {"document_id": 0}):
        with pytest.raises(ValueError):
            lookup.get(d, **wrong)
    assert lookup.one_scope(True, False) == "global"
    with pytest.raises(ValueError):
        lookup.one_scope(False, False)


def test_commands(spark, tmp_path, capsys):
    at = commit(tmp_path / "r", a__md="# A\nthe crane at https://u:p@h.example/?token=7", b__md="# B\nthe rope")
    out = []
    model = evidence.Scripted([{"queries": ["crane"], "enough": True}], [{"answer": "there", "citations": [{"evidence_id": 1}]}])
    c = commands.Context(lambda: spark, E, webpages.RecordedPages(PAGES), model, lambda q: {"results": [{"title": "t", "url": "https://w.example/?key=1"}]}, str(tmp_path), out.append)
    run = lambda *a: commands.main(list(a), c)
    assert run("db", "doctor", "--global") == 0 and "health_status: missing" in out[-1]
    assert run("learn", "git", at) == 0 and "documents: 2" in out[-1]
    assert run("learn", "web", SITE, "--fetch-mode", "get", "--json") == 0 and json.loads(out[-1])["documents"] == 1
    assert run("search", "crane", "--ext", "md", "--limit", "1") == 0 and "[1] a.md" in out[-1] and "token=[REDACTED]" in out[-1] and "u:p" not in out[-1]
    assert run("get", "a.md") == 0 and "title: a.md" in out[-1]
    assert run("ai-search", "where is the crane?") == 0 and "grounding_status: grounded" in out[-1] and "get: lodestrata get --document-id 1" in out[-1]
    assert run("web", "search", "x") == 0 and "key=[REDACTED]" in out[-1]
    assert [t.name for t in c.progress.tasks] == ["chunk and embed", "fetch pages", "chunk and embed"] and c.progress.tasks[0].done == 2
    assert run("smoke", "--page", SITE, "--json") == 0 and json.loads(out[-1])["answer"] == "grounded" and json.loads(out[-1])["page"] > 0
    assert run("db", "stats", "--global") == 0 and "sources: 2" in out[-1] and run("db", "scope", "--global") == 0 and f"[source] {at}" in out[-1]
    assert run("db", "rebuild", "--global") == 0 and "rebuilt: 2" in out[-1]
    c.pages = webpages.RecordedPages({})
    assert run("db", "rebuild", "--global", "--source", SITE, "--retry", "0") == 1 and "failed: 1" in out[-1]
    assert run("db", "clear", "--global") == 1 and run("db", "clear", "--global", "--yes") == 0 and run("db", "stats") == 1 and run("get") == 1
    assert "needs --yes" in capsys.readouterr().err


def test_the_offline_evaluation(spark, tmp_path):
    metrics, spent = evaluation.run(spark, str(tmp_path / "e"))
    assert evaluation.compare(evaluation.BASELINE, metrics) == [] and set(spent) == {"fixtureSetup", "learnGit", "search", "aiSearch", "total"}
    at = str(tmp_path / "b.json")
    evaluation.write_baseline(at, metrics, {"search": 100})
    known, timings = evaluation.read_baseline(at)
    assert evaluation.compare(known, metrics, (timings, {"search": 149})) == [] and evaluation.compare(known, metrics, (timings, {"search": 151}))[0]["metric"] == "timingsMs.search"
    assert evaluation.compare(known, metrics | {"metrics.search.results": 2})[0] == {"metric": "metrics.search.results", "expected": 3, "actual": 2}
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError, match="lacks"):
        evaluation.read_baseline(at)
