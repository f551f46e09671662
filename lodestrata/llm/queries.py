"""The training-text queries by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def limits(spark: SparkSession, d: str) -> dict[str, int]:
    """The table of limits, which is fixed and small."""
    return {r["limit_name"]: r["amount"] for r in table(spark, d, "size_limits").collect()}


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    from . import secrets

    return secrets.found(table(spark, d, "kb_documents"), table(spark, d, "chunks"))


def _p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    from . import secrets

    return secrets.redacted(table(spark, d, "kb_documents"), table(spark, d, "chunks"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    from . import boilerplate, residue

    pages = table(spark, d, "web_fetched_pages")
    return boilerplate.found(pages, residue.bad_pages(pages))


def _p2_body(spark: SparkSession, d: str) -> DataFrame:
    from . import boilerplate

    return boilerplate.main_body(table(spark, d, "web_fetched_pages"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    from . import residue

    return residue.found(table(spark, d, "web_fetched_pages"), table(spark, d, "kb_documents"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    from . import codeorigin

    return codeorigin.found(table(spark, d, "kb_documents"))


def _p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    from . import codeorigin

    return codeorigin.origins(table(spark, d, "kb_documents"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    from . import nearcopies

    return nearcopies.found(table(spark, d, "kb_documents"))


def _p5_classes(spark: SparkSession, d: str) -> DataFrame:
    from . import nearcopies

    return nearcopies.classes_with_links(table(spark, d, "kb_documents"))


def _p5_links(spark: SparkSession, d: str) -> DataFrame:
    from . import nearcopies

    return nearcopies.class_links(table(spark, d, "kb_documents"))


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    from . import splitter

    at = limits(spark, d)
    return splitter.found(table(spark, d, "kb_documents"), at["chunk_size"], at["chunk_overlap"])


def _p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    from . import splitter

    at = limits(spark, d)
    rows = splitter.markdown_rows(table(spark, d, "kb_documents").select("id", "path", "content")).dropDuplicates(["id"])
    return splitter.split_markdown(rows, at["chunk_size"], at["chunk_overlap"])


def _p7_packed(spark: SparkSession, d: str) -> DataFrame:
    from . import packing, tokens

    capacities = {k: v for k, v in limits(spark, d).items() if k.startswith("pack_")}
    return packing.packed(tokens.counted(table(spark, d, "documents")), capacities)


def _p7_fill(spark: SparkSession, d: str) -> DataFrame:
    from . import packing

    capacities = {k: v for k, v in limits(spark, d).items() if k.startswith("pack_")}
    return packing.fill_report(_p7_packed(spark, d), capacities)


def _p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    from . import mixing, tokens

    return mixing.mixed(tokens.counted(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def _p8_shares(spark: SparkSession, d: str) -> DataFrame:
    from . import mixing, tokens
    from .common import cut

    records, mix = cut(tokens.counted(table(spark, d, "documents"))), table(spark, d, "mix_targets")
    return mixing.shares(mixing.draw(records, mix), records, mix)


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    from . import language

    return language.found(table(spark, d, "documents"))


def _p9_languages(spark: SparkSession, d: str) -> DataFrame:
    from . import language

    documents = table(spark, d, "documents")
    return language.document_languages(documents, language.detect(documents, language.fit(documents), every=True))


def _p9_segments(spark: SparkSession, d: str) -> DataFrame:
    from . import language

    documents = table(spark, d, "documents")
    return language.segments(documents, language.fit(documents)).withColumn("confidence", F.round("confidence", 6))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _p1_found,
    "p1_redacted": _p1_redacted,
    "p2_found": _p2_found,
    "p2_body": _p2_body,
    "p3_found": _p3_found,
    "p4_found": _p4_found,
    "p4_reasons": _p4_reasons,
    "p5_found": _p5_found,
    "p5_classes": _p5_classes,
    "p5_links": _p5_links,
    "p6_found": _p6_found,
    "p6_pieces": _p6_pieces,
    "p7_packed": _p7_packed,
    "p7_fill": _p7_fill,
    "p8_mixed": _p8_mixed,
    "p8_shares": _p8_shares,
    "p9_found": _p9_found,
    "p9_languages": _p9_languages,
    "p9_segments": _p9_segments,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(importlib.import_module(f"{__package__}.sql").ORACLES)
