"""Append-only logs and configuration: hits, misses, archives, transcripts, queues, golden sets."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.schema import HITS, QUEUE


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Hit lines; lines that do not parse are skipped."""
    return spark.read.schema(HITS).option("mode", "DROPMALFORMED").json(path)


def fold_hits(lines: DataFrame) -> DataFrame:
    """(id, n, last): weights and last times; a line without weight counts one."""
    return lines.where("id is not null").groupBy("id").agg(F.sum(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).alias("n"), F.max("at").alias("last"))


def command_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("cmd").agg(F.sum(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).alias("n"))


def compact(lines: DataFrame, most: int = 5000) -> DataFrame:
    """One line an id once there are more than `most` lines."""
    if lines.limit(most + 1).count() <= most:
        return lines
    return fold_hits(lines).select(F.lit("compact").alias("cmd"), "id", F.col("last").alias("at"), "n")


def queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE).option("mode", "DROPMALFORMED").json(path)


def pick(entries: DataFrame, now: str, days: int, most: int) -> DataFrame:
    """Oldest entries that are neither done nor too old."""
    age = F.datediff(F.lit(now).cast("date"), F.col("at").cast("date"))
    return entries.where(F.col("done_at").isNull() & (age <= days)).orderBy("at", "session_id").limit(most)


def turns(talk: DataFrame) -> DataFrame:
    """(conv_id, block, role, text): user and assistant turns, reminders out, neighbours of one role merged. talk: (conv_id, turn, role, text)."""
    kept = talk.where(F.col("role").isin("user", "assistant")).withColumn("text", F.btrim(X.clean_talk(F.col("text")))).where("text <> ''")
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)
    blocks = kept.withColumn("new", new).withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return blocks.groupBy("conv_id", "block", "role").agg(F.array_join(texts, "\n").alias("text"))


def exchanges(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of the exchange they are in: a new one begins at each user turn."""
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("exchange", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order))


def chunks(blocks: DataFrame, most_chars: int = 36_000, most_chunks: int = 6) -> DataFrame:
    """(conv_id, chunk, text): exchanges packed newest first into chunks, the newest few kept; the fill is a fold over a conversation."""
    each = exchanges(blocks).groupBy("conv_id", "exchange").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.concat_ws(": ", "role", "text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    newest = each.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("exchange", "text")))).alias("all"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast("array<struct<chunk:int,text:string>>").alias("out"))

    def step(s, x):
        fits = (s["used"] == 0) | (s["used"] + F.length(x["text"]) <= most_chars)
        chunk = F.when(fits, s["chunk"]).otherwise(s["chunk"] + 1)
        used = F.when(fits, s["used"]).otherwise(0) + F.length(x["text"])
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(s["out"], F.array(F.struct(chunk.alias("chunk"), x["text"].alias("text")))).alias("out"))

    placed = newest.select("conv_id", F.posexplode(F.aggregate("all", start, step)["out"]).alias("at", "x")).where(F.col("x.chunk") < most_chunks)
    texts = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("at", F.col("x.text").alias("text"))))), lambda x: x["text"])
    return placed.groupBy("conv_id", F.col("x.chunk").alias("chunk")).agg(F.array_join(texts, "\n").alias("text"))


def config(text: str) -> dict:
    """Settings of a TOML text over the defaults."""
    defaults = {"search": {"k": 10, "bonus_cap": 1.5}, "quality": {"dup_reject": 0.08, "dup_warn": 0.06}, "retain": {"edits": 5, "turns": 8, "nudges": 2}}
    given = tomllib.loads(text)
    return {k: v | given.get(k, {}) for k, v in defaults.items()} | {k: v for k, v in given.items() if k not in defaults}
