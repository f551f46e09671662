"""Whole documents by id or by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.redaction import lookup_path


def by_path(documents: DataFrame, path: str, source_key: str | None = None) -> DataFrame:
    """Documents of a path, of one source if it is given, in order of id."""
    found = documents.where(F.col("path") == lookup_path(path))
    if source_key is not None:
        found = found.where(F.col("source_key") == source_key)
    return found.orderBy("id")


def get(documents: DataFrame, path: str | None = None, document_id: int | None = None, source_key: str | None = None) -> dict:
    """The one document of a path or an id; exactly one of them must be given, and one document be found."""
    if bool(path) == bool(document_id):
        raise ValueError("give either a path or a document id")
    if document_id:
        row = documents.where(F.col("id") == document_id).first()
        if row is None:
            raise LookupError(f"no document {document_id}")
        return row.asDict()
    found = by_path(documents, path, source_key).limit(20).collect()  # candidates to name
    if not found:
        raise LookupError(f"no document at {path}")
    if len(found) > 1:
        raise LookupError("several documents at this path; name a source or an id: " + " | ".join(f"{r['id']} {r['source_key']} {r['path']}" for r in found))
    return found[0].asDict()


def one_scope(everywhere: bool, project: bool) -> str:
    """Commands on the index need exactly one scope."""
    if bool(everywhere) == bool(project):
        raise ValueError("give either the global or the project scope")
    return "global" if everywhere else "project"
