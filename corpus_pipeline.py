"""The corpus pipeline: documents go through STAGES one after the other.

Each stage works on all that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import free_name, with_row_key, written
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.langid import train, with_known_language
from tessella.llm.mixing import mix, mixed_documents
from tessella.llm.near import near_groups
from tessella.llm.packing import packed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter or has no language that the classifier is at all sure of.

    Repeated rows share one fate; an empty table, or one without any labelled text, loses only texts without letters.
    """
    return with_known_language(docs, train(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays, then the one of the smallest id; null texts count as empty.

    Of rows alike in all that, the first stored stays. An empty table stays empty; columns may have any names.
    """
    row = free_name(docs, "_row")
    rows = with_row_key(docs, row)
    gone = free_name(rows, "_gone")
    dropped = exact_dedup(rows, carry=[row]).where("not kept").select(F.col(row).alias(gone))
    return rows.join(dropped, F.col(row) == F.col(gone), "left_anti").drop(row)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, the one of the smallest id stays.

    Null ids come last, and of equal or null ids the first stored stays. Texts without words, null ones too, are all
    alike. An empty table stays empty; columns may have any names.
    """
    row = free_name(docs, "_row")
    rows = with_row_key(docs, row)
    kept = free_name(rows, "_kept")
    told = written(near_groups(rows, carry=[row]).toDF("id", "key", "component"), "near")
    best = told.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("best"))
    return rows.join(best.select(F.col("best.key").alias(kept)), F.col(row) == F.col(kept), "left_semi").drop(row)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights: a row for each pass in which shards drew a document, with the words drawn as text.

    Rows come shard by shard, each shard in an order of its own. Null sources are a source; empty texts give no rows, and
    an empty table stays empty. n_chars, where it is there, is that of the new text; other columns may have any names.
    """
    row = free_name(docs, "_row")
    rows = with_row_key(docs, row)
    drawn = mixed_documents(rows, written(mix(rows, carry=[row]).select(row, "size", "pieces"), "mix"), row)
    n_chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return drawn.withColumns(n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, from the rows in the order in which the mix wrote them; a row for each piece.

    A null or empty text is its end token alone; repeated rows are packed one by one; an empty table gives no rows.
    """
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", source_mix),
    ("packing", packing),
]
#: Fingerprints, a classifier and tokenizers are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
