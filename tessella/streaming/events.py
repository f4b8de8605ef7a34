"""Streams: hit folding with watermarks, sessions by gap, session nudges as keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDITS, TURNS, NUDGES = 5, 8, 2


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hit_windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(day, id, n): hits by window; state of windows older than the watermark goes. Works on streams and tables alike."""
    marked = events.withWatermark("at", late)
    return marked.groupBy(F.window("at", size), "id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "id", "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(id, begin, end, n): runs of events with no gap as long as `gap`."""
    marked = events.withWatermark("at", late)
    return marked.groupBy(F.session_window("at", gap), "id").agg(F.count("*").alias("n")).select("id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def nudge_step(edits: int, turns: int, nudges: int, kind: str) -> tuple[int, int, int, bool]:
    """Counters after an event, and whether to nudge: at 5 edits or 8 turns since the last, twice a session; an add resets."""
    if kind == "add":
        return 0, 0, nudges, False
    edits, turns = edits + (kind == "edit"), turns + (kind == "turn")
    if nudges < NUDGES and (edits >= EDITS or turns >= TURNS):
        return 0, 0, nudges + 1, True
    return edits, turns, nudges, False


def nudge_stream(events: DataFrame, late: str = "1 hour", ttl_ms: int = 86_400_000) -> DataFrame:
    """(id, at) of nudges on a stream of (id, at, kind); a session's state goes after a day of silence."""

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "kind"])
        told = []
        for at, kind in zip(rows["at"], rows["kind"], strict=True):
            *now, hit = nudge_step(*now, kind)
            if hit:
                told.append(at)
        state.update(tuple(now))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"id": [key[0]] * len(told), "at": told})

    return events.groupBy("id").applyInPandasWithState(run, "id long, at timestamp", "edits long, turns long, nudges long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def nudges(events: DataFrame) -> DataFrame:
    """The same on a table: a fold over each session's events in order."""
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("t"), F.lit(0).alias("n"), F.array().cast("array<timestamp>").alias("out"))

    def step(s, x):
        e, t = s["e"] + F.when(x["kind"] == "edit", 1).otherwise(0), s["t"] + F.when(x["kind"] == "turn", 1).otherwise(0)
        hit = (s["n"] < NUDGES) & ((e >= EDITS) | (t >= TURNS)) & (x["kind"] != "add")
        clear = hit | (x["kind"] == "add")
        return F.struct(
            F.when(clear, 0).otherwise(e).alias("e"), F.when(clear, 0).otherwise(t).alias("t"), F.when(hit, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(hit, F.concat(s["out"], F.array(x["at"]))).otherwise(s["out"]).alias("out")
        )

    folded = events.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at", "kind"))), start, step)["out"].alias("out"))
    return folded.select("id", F.explode("out").alias("at"))


def marks(events: DataFrame) -> DataFrame:
    """(session_id, transcript_path, reason, cwd, at) of compact and end events: the last of each session and reason."""
    kept = events.where(F.col("reason").isin("compact", "end"))
    return kept.groupBy("session_id", "reason").agg(F.max_by(F.struct("transcript_path", "cwd"), "at").alias("x"), F.max("at").alias("at")).select("session_id", "x.transcript_path", "reason", "x.cwd", "at")


def still_active(queue: DataFrame, files: DataFrame, now: str, end_minutes: int = 10, compact_minutes: int = 60) -> DataFrame:
    """queue rows with `live`: whether the transcript changed within ten minutes, or sixty after a compaction. files(path, modified)."""
    quiet = F.when(F.col("reason") == "compact", compact_minutes).otherwise(end_minutes)
    joined = queue.join(files.select(F.col("path").alias("_p"), "modified"), F.col("transcript_path") == F.col("_p"), "left")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("modified")) / 60
    return joined.withColumn("live", F.coalesce(age < quiet, F.lit(False))).drop("_p", "modified")


def recent_sessions(events: DataFrame, now: str, minutes: int) -> DataFrame:
    """One row: sessions with an event within so many minutes before now."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("at")
    return events.where((age >= 0) & (age <= minutes * 60)).agg(F.countDistinct("id").alias("sessions"))


def find_session(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session seen last whose id begins so; a prefix of one to seven characters finds none, an empty one the last of all."""
    if 0 < len(prefix) < 8:
        return sessions.where(F.lit(False))
    return sessions.where(F.startswith(F.col("id"), F.lit(prefix))).orderBy(F.desc("seen"), "id").limit(1)


def too_soon(last: str | None, now: str, hours: int = 24) -> bool:
    """Whether less than a day has gone by since the last run."""
    from datetime import datetime, timedelta

    return last is not None and datetime.fromisoformat(now) - datetime.fromisoformat(last) < timedelta(hours=hours)
