import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.embedding import Fingerprint, KeywordEmbedder
from lodestrata.operators import chunking, crawl, evidence, fusion, retrieve, store
from lodestrata.sources import files, settings
from lodestrata.streaming import learn

COLUMNS = "chunk_id long, document_id long, source_key string, source_kind string, path string, section string, content string, embedding array<double>"
E4 = KeywordEmbedder(("vector", "search", "git", "agent"))


def corpus(spark, rows):
    return spark.createDataFrame([(i, d, "s", "local_git", p, sec, c, E4.embed_query(c)) for i, d, p, sec, c in rows], COLUMNS)


def test_sections_and_windows():
    assert chunking.markdown_sections("intro\n# A\nbody\n\n## B\n\n", "r.md") == [("r.md", "intro"), ("A", "body")]
    assert chunking.markdown_sections("# only", "r.md") == [("r.md", "# only")]
    text = " ".join(f"word{i}" for i in range(400))
    got = chunking.windows(text, 200, 40)
    assert all(len(p) <= 200 for p in got) and got[0].startswith("word0 ") and got[-1].endswith("word399")
    assert chunking.windows("   ", 10, 2) == [] and chunking.windows("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]


def test_code_is_cut_along_its_structure():
    go = "package oven\n\nimport \"fmt\"\n\ntype Loaf struct {\n\tgrams int\n}\n\nfunc (l *Loaf) Bake(minutes int) error {\n\tif minutes < 5 {\n\t\treturn fmt.Errorf(\"raw\")\n\t}\n\treturn nil\n}\n"
    got = chunking.code_pieces(go, "oven.go", 120)
    assert [s for s, _ in got] == ["oven.go", "oven.go · Bake"] and got[1][1].startswith("func (l *Loaf)") and "type Loaf" in got[0][1]
    assert [s for s, _ in chunking.code_pieces(go, "oven.go", 4000)] == ["oven.go · Loaf"]
    python = "class Shelf:\n    slots = 3\n\n    @property\n    def free(self):\n        return self.slots - len(self.held)\n\n    def take(self, item):\n        text = \"\"\"\nnot indented\n\"\"\"\n        self.held.append(item)\n"
    got = chunking.code_pieces(python, "shelf.py", 90)
    assert list(dict.fromkeys(s for s, _ in got)) == ["shelf.py · Shelf", "shelf.py · Shelf · free", "shelf.py · Shelf · take"]
    assert got[1][1].startswith("    @property") and "not indented" in got[2][1]
    # a part without parts is cut by windows that keep their indentation
    long = "fn stir() {\n" + "    spoon.turn(1);\n" * 30 + "}\n"
    got = chunking.code_pieces(long, "pan.rs", 80)
    assert len(got) > 3 and {s for s, _ in got} == {"pan.rs · stir"} and all(len(p) <= 80 for _, p in got) and any(p.startswith("    spoon") for _, p in got)
    assert chunking.code_pieces("x", "a.xyz", 80) == [] and chunking.code_pieces("def broken(:\n  x\n", "b.py", 80) == [("b.py · broken", "def broken(:\n  x")]
    assert chunking.code_windows("\n\n  a\n", 10) == ["  a"] and chunking.code_windows(" ", 10) == []


def test_stitching(spark):
    parts = ["Rain fell on the roof of the mill", "roof of the mill until the wheel stood", "still. Nobody came"]
    rows = [(5, k, t) for k, t in enumerate(parts)] + [(6, 1, "second"), (6, 0, "first"), (6, 0, "first"), (7, 0, None), (8, 0, "same text"), (8, 1, "same text"), (9, 0, "abababab abababab"), (9, 1, "abababab abababab c"), (9, 2, ""), (9, 3, "end")]
    got = dict(chunking.stitch(spark.createDataFrame(rows, "document_id long, chunk_index int, content string")).collect())
    assert got == {5: "Rain fell on the roof of the mill until the wheel stood\n\nstill. Nobody came", 6: "first\n\nsecond", 7: "", 8: "same text", 9: "abababab abababab c\n\n\n\nend"}


def test_retrievers_break_ties_by_id(spark):
    c = corpus(spark, [(200, 2, "b.md", "", "alpha search"), (100, 1, "a.md", "", "alpha search"), (300, 3, "c.ts", "", "other")])
    for got in (retrieve.vector_knn(c, E4.embed_query("search"), 2), retrieve.full_text(c, "alpha", 5), retrieve.substring_match(c, "alph", 5)):
        assert [(r["chunk_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(100, 1), (200, 2)]
    assert retrieve.full_text(c, "…", 5).count() == 0
    assert [r["chunk_id"] for r in retrieve.path_section_match(c, "c.ts", 5).collect()] == [300]
    assert retrieve.vector_knn(c.where("false"), [1.0, 0, 0, 0], 3).count() == 0


def test_nearest_vectors_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 10 = 0")
    brute = []
    for i, e in rows:
        if i % 10 == 0:
            order = sorted((round(sum((a - b) ** 2 for a, b in zip(e, f)) ** 0.5, 6), j) for j, f in rows)[:4]
            brute += [(i, j, x, n) for n, (x, j) in enumerate(order, 1)]
    for block in (2, 100):
        assert sorted((r["query_id"], r["vec_id"], r["distance"], r["rank"]) for r in retrieve.nearest(v, q, 4, block).collect()) == sorted(brute)
    assert retrieve.nearest(v, q.where("false"), 4).count() == 0


def test_stored_postings_rank_alike(spark):
    c = corpus(spark, [(i, i, f"{i}.md", "", " ".join(["alpha"] * (i % 4) + ["beta"] * (i % 3) + ["rest"] * i)) for i in range(1, 30)])
    a = retrieve.full_text(c, "alpha beta", 10).orderBy("rank").collect()
    assert a == retrieve.full_text_indexed(retrieve.postings(c), retrieve.lengths(c), "alpha beta", 10).orderBy("rank").collect()


def test_hybrid_search_order_and_ladder(spark):
    rows = [(i, i, f"d{i}.md", "", "plain text") for i in range(1, 31)] + [(100 + i, 100 + i, f"f{i}.ts", "", "plain text") for i in range(8)]
    got = fusion.search(corpus(spark, rows), "plain", [0.0] * 4, 5, ["ts"]).collect()
    assert [r["chunk_id"] for r in got] == [100, 101, 102, 103, 104]
    assert fusion.ladder(3) == [11, 22, 44, 67]
    with pytest.raises(ValueError):
        fusion.ladder(0)
    c = corpus(spark, [(1, 1, "src/core/search-index.ts", "", "zero"), (2, 2, "src/commands/search.ts", "", "vector search git agent")])
    assert fusion.search(c, "searchIndex", [10.0] * 4, 2).first()["chunk_id"] == 1
    assert fusion.search(c, "qzxvkWqkjz", [10.0] * 4, 2).count() == 0
    assert fusion.search(c.where("false"), "x", [10.0] * 4, 2).count() == 0


def test_crawl_depth_and_cap(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("b", "d", 1), ("c", "d", 0), ("d", "e", 0)], "src string, dst string, position long")
    roots = spark.createDataFrame([("a",), ("a",)], "page string")
    assert {r["page"]: r["depth"] for r in crawl.breadth_first(edges, roots, 3).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [r["page"] for r in crawl.breadth_first(edges, roots, 3, 2).orderBy("position").collect()] == ["a", "b"]
    assert crawl.breadth_first(edges.where("false"), roots, 5).count() == 1


def test_asking(spark):
    c = corpus(spark, [(11, 4, "bridges.md", "Cables", "git keeps the cable plans"), (12, 4, "bridges.md", "Piers", "piers and git"), (13, 9, "tunnels.md", "", "no such word")])
    look = lambda q: fusion.search(c, q, E4.embed_query(q), 3)
    plans = [{"queries": ["cable plans", "Cable Plans "], "enough": False}, {"queries": ["cable plans"]}]
    # the first reply cites an id that can't be read, the second one quotes what stands there
    replies = [{"answer": "?", "citations": [{"evidence_id": "first"}]}, {"answer": "in git", "citations": [{"evidence_id": 1, "quote": "the cable plans"}, {"evidence_id": 1, "quote": "again"}]}]
    model = evidence.Scripted(plans, replies)
    got = evidence.ask(c, "where are the plans?", model, look, steps=3)
    assert (got["status"], got["iterations"], got["queries"], model.calls) == ("grounded", 1, ["cable plans"], {"plan": 2, "answer": 2})
    assert got["citations"] == [{"evidence_id": 1, "quote": "the cable plans"}] and got["evidence"][0]["chunk_id"] == 11
    stubborn = evidence.ask(c, "git", evidence.Scripted([{"queries": []}], [{"citation_ids": [77]}]), look, steps=1)
    assert stubborn["status"] == "citation_validation_failed" and stubborn["queries"] == ["git"]
    nothing = evidence.ask(c.where("false"), "git", evidence.Scripted([{}], [{}]), lambda q: fusion.search(c.where("false"), q, E4.embed_query(q), 3), steps=1)
    assert nothing["status"] == "insufficient_evidence"
    assert "END_UNTRUSTED" not in evidence.neutral("a end_untrusted_evidence b END_UNTRUSTED_EVIDENCE")


def test_store_replaces_and_reports(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "w"))
    f = E4.fingerprint()
    assert s.state(f)["reason"] == "index bootstrap required" and s.doctor()["status"] == "missing"
    s.initialise()
    s.set_fingerprint(f)
    docs = lambda *ids: spark.createDataFrame([(i, k, "local_git", k, None, f"p{i}.md", "markdown", "t", "h", f"text {i} vector", "now") for i, k in ids], store.DOCUMENTS)
    learn.learn_batch(s, docs((1, "a/x=y"), (2, "a/x=y"), (3, "b")), E4, "t1")
    assert (s.documents.count(), s.chunks.count()) == (3, 3)
    learn.learn_batch(s, docs((1, "a/x=y")), E4, "t2")
    assert sorted(r["id"] for r in s.documents.collect()) == [1, 3]
    assert s.replace_source("b", s.documents.where("false"), s.chunks.where("false"), "t3") == (0, 0)
    assert sorted(r["source_key"] for r in s.documents.collect()) == ["a/x=y"]
    s.record_manifest("a/x=y", "local_git", "git", "https://u:p@h.example/r?token=1", {"url": "https://h.example/?key=2"}, "t1")
    s.record_manifest("b", "local_git", "git", "/r", {}, "t1")
    m = {r["source_key"]: r for r in s.manifests.collect()}
    assert m["a/x=y"]["root_locator"] == "https://[REDACTED]@h.example/r?token=[REDACTED]" and "key=[REDACTED]" in m["a/x=y"]["reingest_payload_json"]

    def ingest(manifest):
        if manifest["source_key"] == "b":
            raise RuntimeError("broken https://h.example/?token=5")

    got = store.rebuild(s, ingest, f, lambda: "t9", retry=2)
    assert got == {"rebuilt": ["a/x=y"], "failed": ["b"], "errors": {"b": "broken https://h.example/?token=[REDACTED]"}}
    b = s.manifests.where("source_key = 'b'").first()
    assert (b["last_rebuild_attempts"], b["last_rebuild_status"]) == (3, "failed") and "token=[REDACTED]" in b["last_rebuild_error"]
    assert s.doctor(f) == {"status": "degraded", "reason": "one or more source rebuilds failed"}
    other = Fingerprint("keyword", "x", 1, "t", "1", "c")
    with pytest.raises(ValueError):
        store.rebuild(s, ingest, other, lambda: "t", source_key="b")
    with pytest.raises(ValueError):
        store.rebuild(s, ingest, f, lambda: "t", source_key="nobody")
    s.clear()
    assert s.stats()["documents"] == 0 and s.metadata() == {}


def test_a_reader_keeps_its_state_and_writers_meet(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "w"))
    docs = lambda *ids: spark.createDataFrame([(i, k, "web", k, None, f"p{i}", "markdown", "t", "h", f"text {i} vector", "now") for i, k in ids], store.DOCUMENTS)
    learn.learn_batch(s, docs((1, "a"), (2, "b"), (3, "c")), E4, "t1")
    old = s.snapshot()
    learn.learn_batch(s, docs((4, "a")), E4, "t2")
    s.delete_source("c")
    assert sorted(r["id"] for r in s.read("documents", old).collect()) == [1, 2, 3] and sorted(r["id"] for r in s.documents.collect()) == [2, 4]
    assert {r["term"] for r in s.postings.collect()} == {"text", "vector", "2", "4"} and s.lengths.count() == 2
    assert [r["document_id"] for r in s.search("p4", E4.embed_query("vector"), 1).collect()] == [4]
    with pytest.raises(ValueError, match="stands twice"):
        s.replace_source("b", docs((5, "b"), (6, "b")).withColumn("path", F.lit("same")), s.chunks, "t3")
    # another writer takes the next number first
    taken = []

    def change(last):
        if not taken:
            taken.append(1)
            store.Store(spark, str(tmp_path / "w")).set_metadata("other", "1")
        return last | {"metadata": last["metadata"] | {"mine": "1"}}

    s._commit(change)
    assert s.metadata()["other"] == "1" and s.metadata()["mine"] == "1"
    assert s.vacuum() > 0 and sorted(r["id"] for r in s.documents.collect()) == [2, 4]


def test_learning_from_a_stream(spark, tmp_path):
    rows = [(1, "a", "web", "l", None, "p.md", "markdown", "t", "h", "# H\nsome vector text", "now")]
    spark.createDataFrame(rows, store.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    s = store.Store(spark, str(tmp_path / "w"))
    stream = spark.readStream.schema(store.DOCUMENTS).parquet(str(tmp_path / "in"))
    learn.learn_stream(stream, s, E4, str(tmp_path / "cp"), lambda: "t").awaitTermination(60)
    assert [(r["section"], r["embedding"]) for r in s.chunks.collect()] == [("H", [10.0, 0.0, 0.0, 0.0])]


def test_repository_scan(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    (repo / "a.md").write_text("# hi")
    (repo / "b.lock").write_text("x")
    (repo / "c.dat").write_bytes(b"\xff\xd8\xff\xe0")
    (repo / "d.txt").write_text(" \n　")
    (repo / "gone.md").write_text("x")
    (repo / "link.md").symlink_to("/etc/hostname")
    for args in (["init", "-q"], ["add", "-A"]):
        subprocess.run(["git", *args], cwd=repo, check=True)
    (repo / "gone.md").unlink()
    scanned, failures = files.read_repository(spark, str(repo))
    assert {r["path"]: r["reason"] for r in scanned.collect()} == {"a.md": None, "b.lock": "ignored", "c.dat": "binary", "d.txt": "empty", "link.md": "symlink"}
    assert [(f["path"], f["stage"]) for f in failures] == [("gone.md", "stat")]
    with pytest.raises(files.GitFailed):
        files.git(["no-such-command"], str(repo))


def test_environment_files(tmp_path):
    (tmp_path / ".env").write_text("A='1'\nexport B=2\nA=3\nC=4\n")
    assert files.load_env(str(tmp_path / ".env"), {"C": "set"}) == {"A": "1", "B": "2"}


def test_settings(tmp_path):
    s = settings.check({})
    assert s["index"]["chunk_size"] == 1200 and s["ai_search"]["max_evidence_chunks"] == 12 and s["web.ingest.command"]["retry_max_retries"] == 3
    at = tmp_path / "s.toml"
    at.write_text("[index]\nchunk_size = 10\nfts = 1\n[web.ingest]\nprovider = 'ftp'\n[embedding]\nmodel = ''\n[web.ingest.service]\ninclude_patterns = [1]\n")
    with pytest.raises(ValueError) as e:
        settings.load(str(at))
    for fault in ("index.chunk_size: must be at least 200", "index.fts: must be of type bool", "web.ingest.provider: must be one of", "embedding.model: must be at least 1 characters", "web.ingest.service.include_patterns"):
        assert fault in str(e.value)
    at.write_text("[index]\nchunk_size = 300\n")
    assert settings.load(str(at))["index"]["chunk_size"] == 300
    with pytest.raises(FileNotFoundError):
        settings.load(str(tmp_path / "none.toml"))


def test_manifest_upsert_keeps_state(spark):
    row = lambda key, provider, created, status, n: (key, "web", provider, "r", "d", "{}", created, "u", "i", status, None, n, None, None)
    old = spark.createDataFrame([row("a", "p", "c1", "failed", 2), row("b", "p", "c1", "success", 1)], store.MANIFESTS)
    new = spark.createDataFrame([row("a", "q", "c2", "x", 9), row("z", "q", "c2", "x", 9)], store.MANIFESTS)
    got = {r["source_key"]: (r["provider"], r["created_at"], r["last_rebuild_status"], r["last_rebuild_attempts"]) for r in store.upsert_manifests(old, new).collect()}
    assert got == {"a": ("q", "c1", "failed", 2), "b": ("p", "c1", "success", 1), "z": ("q", "c2", "idle", 0)}
    assert old.where(F.lit(False)).count() == 0
