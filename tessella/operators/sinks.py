"""Mutations as tables: snapshots with a pointer, appends, merges, archives, guarded updates. Nothing is changed in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import storage
from tessella.operators import lifecycle as L

#: Lines of a body that more may be appended to, keys of a note, and bytes of the miss log.
APPEND_LINES, KEYS, MISS_BYTES = 120, 6, 1 << 20


def publish(tables: DataFrame | dict[str, DataFrame], path: str) -> str:
    """Writes a snapshot below path and then points `current` to it, so that readers see the old or the new tables whole.

    Several tables are a dict by name; they change together, as the pointer is one small file that is renamed into place.
    Returns the snapshot's folder.
    """
    frames = tables if isinstance(tables, dict) else {"": tables}
    spark = next(iter(frames.values())).sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    for part, frame in frames.items():
        frame.write.parquet(f"{path}/{name}/{part}" if part else f"{path}/{name}")
    jvm = spark.sparkContext._jvm
    fs, target = storage._folder(spark, f"{path}/current")
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}/current-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(name.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise RuntimeError(f"the pointer of {path} was not replaced")
    return f"{path}/{name}"


def published(spark: SparkSession, path: str, part: str = "") -> DataFrame:
    """The snapshot that `current` points to, or one of its tables."""
    name = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{name}/{part}" if part else f"{path}/{name}")


def note_files(notes: DataFrame, path: str) -> None:
    """Notes as Markdown, one row each with the path YYYY/MM/id.md, in one snapshot of (path, markdown)."""
    from tessella.sources.notes import encode

    named = notes.select("id", F.concat_ws("/", F.date_format("created", "yyyy/MM"), F.concat(F.col("id"), F.lit(".md"))).alias("path"))
    publish(encode(notes).join(named, "id").select("path", "markdown"), path)


def append_json(rows: DataFrame, path: str) -> None:
    """Rows at the end of a JSON log: hits, requests, log lines."""
    rows.write.mode("append").json(path)


def drop_notes(notes: DataFrame, gone: DataFrame) -> DataFrame:
    return notes.join(gone.select("id"), "id", "left_anti")


def merged_body(body: Column, more: Column, day: Column) -> Column:
    """More text under a dated heading, if the body has up to 120 lines; else the body as it is."""
    room = F.size(F.split(body, "\n", -1)) <= APPEND_LINES
    return F.when(room, F.concat(body, F.lit("\n\n## "), day.cast("string"), F.lit("\n\n"), more)).otherwise(body)


def merge_twins(notes: DataFrame, additions: DataFrame) -> DataFrame:
    """notes with additions(twin, body, keys, created) appended to their twins, each note's in order of time and text; keys join, six at most."""
    parts = F.array_sort(F.collect_list(F.struct("created", "body", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))))
    more = additions.groupBy(F.col("twin").alias("_twin")).agg(parts.alias("_more"))
    step = lambda body, x: merged_body(body, x["body"], x["created"])
    joined = notes.join(more, F.col("id") == F.col("_twin"), "left")
    body = F.when(F.col("_more").isNull(), F.col("body")).otherwise(F.aggregate("_more", F.col("body"), step))
    keys = F.slice(F.array_distinct(F.concat(F.coalesce("keys", F.array().cast("array<string>")), F.flatten(F.transform("_more", lambda x: x["keys"])))), 1, KEYS)
    out = joined.withColumn("body", body)
    if "keys" in notes.columns:
        out = out.withColumn("keys", F.when(F.col("_more").isNull(), F.col("keys")).otherwise(keys))
    return out.drop("_twin", "_more")


def archive_rows(notes: DataFrame, op: str, at: Column) -> DataFrame:
    """(op, id, path, archived_at, markdown) of notes as they are, for the archive."""
    from tessella.sources.notes import encode

    path = F.col("path") if "path" in notes.columns else F.lit(None).cast("string")
    return encode(notes).join(notes.select("id", path.alias("path")), "id").select(F.lit(op).alias("op"), "id", "path", at.alias("archived_at"), "markdown")


def append_archive(rows: DataFrame, path: str) -> None:
    """Archive rows at the end of their day's folder."""
    rows.withColumn("day", F.to_date("archived_at")).write.mode("append").partitionBy("day").parquet(path)


def replace_bodies(notes: DataFrame, bodies: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(notes with the new bodies(id, body), archive rows of what they were): write the archive before the notes."""
    new = bodies.select(F.col("id").alias("_id"), F.col("body").alias("_body"))
    touched = notes.join(new.select(F.col("_id").alias("id")), "id", "left_semi")
    changed = notes.join(new, F.col("id") == F.col("_id"), "left").withColumn("body", F.coalesce("_body", "body")).drop("_id", "_body")
    return changed, archive_rows(touched, "body", at)


def fold_notes(notes: DataFrame, planned: DataFrame, state: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(notes with the planned ones folded to `state`, archive rows): warm bodies are squeezed, cold ones keep their first paragraph."""
    mine = planned.select(F.col("id").alias("_id"))
    touched = notes.join(mine.select(F.col("_id").alias("id")), "id", "left_semi")
    body = L.compress(F.col("body")) if state == "warm" else F.substring_index("body", "\n\n", 1)
    hit = F.col("_id").isNotNull()
    out = notes.join(mine, F.col("id") == F.col("_id"), "left").withColumn("body", F.when(hit, body).otherwise(F.col("body")))
    if "state" in notes.columns:
        out = out.withColumn("state", F.when(hit, state).otherwise(F.col("state")))
    return out.drop("_id"), archive_rows(touched, state, at)


def with_hits(notes: DataFrame, totals: DataFrame) -> DataFrame:
    """Notes with hit_count and last_hit_at set from totals(id, n, last) alone: what no total names has none."""
    t = totals.select(F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("last").alias("_last"))
    joined = notes.drop("hit_count", "last_hit_at").join(t, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("hit_count", F.coalesce("_n", F.lit(0)).cast("long")).withColumn("last_hit_at", F.col("_last")).drop("_id", "_n", "_last")


def misses(results: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(query, at) of results(query, at, hits, relaxed) without a strict hit, for the miss log; none once the log has 1 MiB."""
    out = results.where((F.col("hits") == 0) | F.col("relaxed")).select("query", "at")
    if log is None:
        return out
    size = log.agg(F.coalesce(F.sum(F.octet_length("query") + 32), F.lit(0)).alias("size"))
    return out.crossJoin(F.broadcast(size)).where(F.col("size") < MISS_BYTES).drop("size")  # one row


def mark_done(queue: DataFrame, marks: DataFrame) -> DataFrame:
    """queue with done_at, result and saved of marks(session_id, picked_at, done_at, result, saved), only where `at` is still picked_at."""
    m = marks.select(F.col("session_id").alias("_s"), F.col("picked_at").alias("_at"), F.col("done_at").alias("_done"), F.col("result").alias("_result"), F.col("saved").alias("_saved"))
    joined = queue.join(m, (F.col("session_id") == F.col("_s")) & F.col("at").eqNullSafe(F.col("_at")), "left")
    hit = F.col("_s").isNotNull()
    set_ = lambda c, v: F.when(hit, F.col(v)).otherwise(F.col(c)).alias(c)
    new = {"done_at": "_done", "result": "_result", "saved": "_saved"}
    return joined.select(*[set_(c, new[c]) if c in new else F.col(c) for c in queue.columns])


def prune_plan(queue: DataFrame, now: str, days: int, done_days: int = 7) -> DataFrame:
    """(session_id, at): rows too old, or done for long."""
    age = lambda c: F.datediff(F.lit(now).cast("date"), F.col(c).cast("date"))
    return queue.where((age("at") > days) | (age("done_at") > done_days)).select("session_id", "at")


def pruned(queue: DataFrame, plan: DataFrame) -> DataFrame:
    return queue.join(plan, ["session_id", "at"], "left_anti")
