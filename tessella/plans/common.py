"""What the registered queries share: tables, notes, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella import storage
from tessella.operators.index import Index, build
from tessella.schema import AS_OF, notes_from_documents

__all__ = ["AS_OF", "NOTES_SQL", "TOKENS_SQL", "index", "notes", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_from_documents(storage.spread(table(spark, sf_dir, "documents")))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the notes, built by the first query of an application that asks for it and read by the others.

    Its folder has the digest of the documents' files in its name, so that other or changed files have an index of their
    own; _SUCCESS of the last table tells that it is whole.
    """
    documents = table(spark, sf_dir, "documents")
    path = f"{storage.shared_dir(spark)}/tessella-index/{spark.sparkContext.applicationId}-{storage.stamp(spark, documents)}"
    if not storage.exists(spark, f"{path}/statistics/_SUCCESS"):
        build(notes_from_documents(storage.spread(documents)), path)
        storage.kept_until_end(spark, path)
    return Index(spark, path)


NOTES_SQL = """notes AS (
  SELECT d.doc_id AS id, ['todo','history','issue','caution','decision','howto','fact','observation'][(d.doc_id % 8)::INT + 1] AS type,
         left(split_part(d.text, chr(10), 1), 40) AS title, left(d.text, 120) AS summary, d.text AS body, [d.lang, d.source] AS tags, d.source AS scope,
         DATE '2024-01-01' + (d.doc_id % 400)::INT AS created, d.doc_id % 50 = 0 AS pinned, 1 + d.doc_id % 5 AS importance,
         CASE WHEN d.doc_id % 17 = 0 THEN DATE '2024-01-01' + (d.doc_id % 400)::INT + 30 END AS invalid_at, s.doc_id AS superseded_by
  FROM documents d LEFT JOIN (SELECT doc_id FROM documents WHERE (doc_id - 1) % 23 = 0) s ON s.doc_id = d.doc_id + 1)"""
LIVE_SQL = "(superseded_by IS NULL AND (invalid_at IS NULL OR invalid_at > DATE '2025-02-10'))"


def TOKENS_SQL(x: str) -> str:  # noqa: N802
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{Nd}}]+'), lambda t: t <> '')"
