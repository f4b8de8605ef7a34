"""Note files: Markdown with flat front matter, read by Spark's binary reader and parsed in Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTS = ("tags", "keys", "sources", "links")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content, hash) of all .md files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("hash", F.sha2("content", 256))


@F.pandas_udf(T.StringType())
def _korean(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("cp949", "replace"))


def decode(content: Column) -> Column:
    """UTF-8, or else the Korean code page 949; a leading byte-order mark goes, line ends become newlines.

    Only files that are no UTF-8 go to Python, as the engine has no such code page. Bytes that neither has become
    replacement characters; a null stays null.
    """
    good = F.is_valid_utf8(content.cast("string"))
    plain = F.coalesce(F.when(good, content.cast("string")), _korean(F.when(~good, content)))
    return F.regexp_replace(F.regexp_replace(plain, "^\ufeff", ""), "\r\n", "\n")


def _field(head: Column, name: str) -> Column:
    raw = F.btrim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.nullif(F.regexp_replace(raw, "^[\"'](.*)[\"']$", "$1"), F.lit(""))


def _list(head: Column, name: str) -> Column:
    """Flow lists [a, b], or block lists of `- a` lines."""
    flow = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1)
    block = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t].*(?:\n|$))+)", 1)
    items = F.when(flow != "", F.split(flow, ",")).otherwise(F.split(block, "\n"))
    clean = F.transform(items, lambda x: F.regexp_replace(F.btrim(F.regexp_replace(F.btrim(x), r"^-[ \t]+", "")), "^[\"'](.*)[\"']$", "$1"))
    return F.filter(clean, lambda x: x != "")


def parse(files: DataFrame) -> DataFrame:
    """Notes of scanned files; `readable` tells whether the front matter was found."""
    text = decode(F.col("content"))
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)^---\n.*?\n---[ \t]*(?:\n|$)", ""), r"^\n+|\n+$", "")
    names = ("id", "type", "title", "summary", "scope", "author", "todo_status", "severity", "superseded_by", "state", "origin", "basis_hash")
    return files.withColumn("_head", head).withColumn("body", body).select(
        "path", "hash", (F.col("_head") != "").alias("readable"), *[_field(F.col("_head"), n).alias(n) for n in names], *[_list(F.col("_head"), n).alias(n) for n in LISTS],
        *[F.try_to_date(_field(F.col("_head"), n)).alias(c) for n, c in (("date", "created"), ("invalid_at", "invalid_at"), ("stale_after", "stale_after"))],
        F.coalesce(_field(F.col("_head"), "pinned") == "true", F.lit(False)).alias("pinned"), F.coalesce(F.expr("try_cast(regexp_extract(_head, '(?m)^importance:[ \\t]*(\\\\d+)', 1) AS int)"), F.lit(3)).alias("importance"), "body",
    )


def encode(notes: DataFrame) -> DataFrame:
    """(id, markdown): notes as files again, fields in fixed order, blank ones left out."""
    line = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(n).cast("string")))
    several = lambda n: F.when(F.size(n) > 0, F.concat(F.lit(f"{n}: ["), F.array_join(n, ", "), F.lit("]")))
    order = ["id", "type", "title", "summary", *LISTS, "scope", "author", "superseded_by", "invalid_at", "severity", "todo_status"]
    head = [(several if n in LISTS else line)(n) for n in order if n in notes.columns] + [F.concat(F.lit("date: "), F.col("created").cast("string"))]
    return notes.select("id", F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n"), F.col("body"), F.lit("\n")).alias("markdown"))
