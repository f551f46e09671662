from pyspark.sql import functions as F

from lodestrata.functions import redaction as X
from lodestrata.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_terms_agree_with_their_literal_twin(spark):
    for s in ("searchIndex in src/core/search-index.ts", "HTTPServer v2.0 naïve", "a b", "", "x" * 300, "Größe der Tabelle 7"):
        assert one(spark, s, T.search_terms) == T.terms_of(s)
    assert T.terms_of("searchIndex") == ["searchindex", "search", "index"]


def test_trim_and_tokens(spark):
    assert one(spark, "﻿ 　 a b \n", T.trim_all) == "a b"
    assert one(spark, "", T.estimate_tokens) == 1
    assert one(spark, "abcde", T.estimate_tokens) == 2
    assert one(spark, None, T.compact) is None


def test_snippet_marks_cut_sides(spark):
    text = "prefix " * 48 + "embedding fingerprint changed here" + " tail" * 60
    s = one(spark, text, lambda c: T.snippet(c, "embedding fingerprint"))
    assert s.startswith("…") and s.endswith("…") and "embedding fingerprint changed" in s
    assert one(spark, "short\n text", T.snippet) == "short text"
    assert len(one(spark, "y" * 500, T.snippet)) == 220


def test_identifier_queries():
    assert T.needs_lexical_match("searchIndex") and T.needs_lexical_match("search_index")
    assert not T.needs_lexical_match("search index") and not T.needs_lexical_match("short1")


def test_suffixes_are_normalised(spark):
    assert T.normalize_suffixes([" TS ", ".md", "ts", "", ".", "undefined", "a b", "x/y"]) == [".ts", ".md"]
    df = spark.createDataFrame([("a.ts",), ("a.tsx",), ("b.md",)], "path string")
    assert [r[0] for r in df.where(T.has_suffix(F.col("path"), [".ts"])).collect()] == ["a.ts"]


def test_url_redaction():
    assert X.redact_url("https://user:pw@Host.example/a?token=abc&q=x y#sig=1") == "https://[REDACTED]@host.example/a?token=[REDACTED]&q=x%20y#sig=[REDACTED]"
    assert X.redact_url("https://h.example?a=1#frag", drop_fragment=True) == "https://h.example/?a=1"
    assert X.redact_url("no url") is None and X.redact_url("repo:x") is None
    assert X.redact_deep({"a": ["see https://h.example/?key=1 now"], "n": 3}) == {"a": ["see https://h.example/?key=[REDACTED] now"], "n": 3}


def test_url_scope_and_paths(spark):
    df = spark.createDataFrame([("https://h.example/docs/a",), ("https://h.example/docs",), ("https://h.example/blog",), ("https://o.example/docs/a",)], "u string")
    assert [r[0] for r in df.select(X.in_scope(F.col("u"), "https://h.example/docs")).collect()] == [True, True, False, False]
    for u, p in (("https://h.example/", "index.md"), ("https://h.example/a/b", "a/b.md"), ("https://h.example/a.html?x=1", "a.html"), ("https://h.example/docs/", "docs/.md")):
        assert one(spark, u, X.chunk_path) == p
    assert X.absolute_url("../x#y", "https://h.example/a/b") == "https://h.example/x" and X.absolute_url("mailto:a@b.c", "https://h.example/") is None


def test_json_candidate(spark):
    assert one(spark, 'Sure:\n```json\n{"a": 1}\n```', T.json_candidate) == '{"a": 1}'
    assert one(spark, 'x {"a": [1]} y', T.json_candidate) == '{"a": [1]}'
    assert one(spark, " plain ", T.json_candidate) == "plain"
