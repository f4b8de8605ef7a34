"""Ingestion in micro-batches: requests decoded, told apart by keys, promoted to notes; replays add nothing.

The store is a published snapshot (operators.sinks). A batch reads it, works out the new one and publishes it together with
the keys it has seen; a batch that is run again finds its keys and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import storage
from tessella.functions import text as X
from tessella.operators import sinks as S

#: Days within which a note of equal type and tags may be a twin, likeness of titles, days that keys are kept.
TWIN_DAYS, TWIN_LIKE, SEEN_DAYS = 7, 0.8, 30
REQUEST = "key string, op string, at timestamp, id string, type string, title string, summary string, body string, tags array<string>, keys array<string>, scope string, target string, fields map<string, string>"
PATCHABLE = ("title", "summary", "scope", "todo_status", "severity", "superseded_by")


def decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, rejected) of files(name, content): add, patch and body requests by `op`, and what is none, with a reason.

    The key is the file's name, so that a file delivered twice is one request.
    """
    parsed = files.select("name", "content", F.from_json("content", REQUEST.replace("key string, ", "")).alias("x")).withColumn("reason", _reason(F.col("x")))
    good = parsed.where("reason IS NULL").select(F.col("name").alias("key"), "x.*")
    return good, parsed.where("reason IS NOT NULL").select("name", "content", "reason")


def _reason(x: Column) -> Column:
    blank = lambda c: F.coalesce(x[c], F.lit("")) == ""
    return (
        F.when(x.isNull() | x["op"].isNull(), "unreadable")
        .when(~x["op"].isin("add", "patch", "body"), "unknown op")
        .when((x["op"] == "add") & (blank("id") | blank("type") | blank("body")), "incomplete")
        .when((x["op"] != "add") & blank("target"), "no target")
        .when((x["op"] == "body") & blank("body"), "incomplete")
    )


def twins(adds: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """(key, twin, exact): add requests with a stored note of equal type, scope and body, or of equal type and tags and a like title.

    The second kind are notes of the last seven days that are neither pinned nor folded; the most alike, then smallest id,
    is the twin. An exact twin wins.
    """
    digest = lambda d: d.withColumn("_b", F.sha2("body", 256))
    stored = digest(notes).groupBy("type", "scope", "_b").agg(F.min("id").alias("twin"))
    exact = digest(adds).join(stored, ["type", "scope", "_b"]).select("key", "twin", F.lit(True).alias("exact"))
    tags = F.array_join(F.array_sort(F.array_distinct("tags")), " ")
    recent = notes.where((F.datediff(F.lit(as_of).cast("date"), "created") <= TWIN_DAYS) & ~F.coalesce("pinned", F.lit(False)))
    recent = recent.where(F.coalesce("state", F.lit("")) == "") if "state" in notes.columns else recent
    grams = lambda c: X.grams(X.similarity_normal(F.col(c)))
    near = adds.select("key", "type", tags.alias("_t"), grams("title").alias("a")).join(recent.select("id", "type", tags.alias("_t"), grams("title").alias("b")), ["type", "_t"])
    near = near.select("key", "id", X.jaccard(F.col("a"), F.col("b")).alias("like")).where(F.col("like") >= TWIN_LIKE)
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("like")).alias("far"), "id")).alias("n")).select("key", F.col("n.id").alias("twin"), F.lit(False).alias("exact"))
    return exact.unionByName(best.join(exact.select("key"), "key", "left_anti"))


def promote(notes: DataFrame, requests: DataFrame, seen: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, keys, archive) after a batch: new notes added, twins merged, patches and bodies put in.

    Requests whose key was seen, and repeated keys, count once. Of adds of one batch with equal type, scope and body the
    one of smallest key is the note. An exact twin changes nothing; a near twin gets the body appended and keys joined.
    Patches and bodies of an id that was merged away in this batch go to the note that survived; of several patches of a
    field the latest counts. Patches to ids that are not there are dropped with their keys remembered.
    """
    new = requests.dropDuplicates(["key"]).join(seen.select("key"), "key", "left_anti")
    adds = new.where("op = 'add'").withColumn("created", F.to_date("at"))
    found = twins(adds, notes, as_of)
    fresh = adds.join(found.select("key"), "key", "left_anti").withColumn("_b", F.sha2("body", 256))
    first = F.row_number().over(Window.partitionBy("type", "scope", "_b").orderBy("key"))
    head = F.first("id").over(Window.partitionBy("type", "scope", "_b").orderBy("key"))
    ranked = fresh.withColumn("_n", first).withColumn("_head", head)
    created = ranked.where("_n = 1")
    moved = adds.join(found, "key").select(F.col("id").alias("was"), F.col("twin").alias("now")).union(ranked.where("_n > 1").select("id", "_head"))
    shared = [c for c in notes.columns if c in created.columns]
    store = notes.unionByName(created.select(*shared), allowMissingColumns=True)
    merges = adds.join(found.where("NOT exact"), "key").select("twin", "body", "keys", "created")
    store = S.merge_twins(store, merges)
    moved = moved.where("was <> now").groupBy("was").agg(F.min("now").alias("now"))
    changes = new.where("op <> 'add'").join(moved, F.col("target") == F.col("was"), "left").withColumn("target", F.coalesce("now", "target"))
    fields = changes.where("op = 'patch'").select("target", "at", "key", F.explode("fields").alias("field", "value")).where(F.col("field").isin(*PATCHABLE))
    latest = fields.groupBy("target", "field").agg(F.max_by("value", F.struct("at", "key")).alias("value"))
    wide = latest.groupBy("target").pivot("field", list(PATCHABLE)).agg(F.first("value"))
    patched = store.join(wide.select(F.col("target").alias("_t"), *[F.col(c).alias(f"_p_{c}") for c in PATCHABLE]), F.col("id") == F.col("_t"), "left")
    store = patched.select(*[F.coalesce(F.col(f"_p_{c}").cast(patched.schema[c].dataType), F.col(c)).alias(c) if c in PATCHABLE else F.col(c) for c in store.columns])
    bodies = changes.where("op = 'body'").groupBy("target").agg(F.max_by("body", F.struct("at", "key")).alias("body")).withColumnRenamed("target", "id")
    store, archive = S.replace_bodies(store, bodies, F.current_timestamp())
    keys = new.select("key", F.lit(as_of).cast("date").alias("seen"))
    return store, keys, archive


def expired(seen: DataFrame, as_of: str, days: int = SEEN_DAYS) -> DataFrame:
    """Keys of the last days: what may still be delivered again."""
    return seen.where(F.datediff(F.lit(as_of).cast("date"), "seen") <= days)


def unchanged(spark: SparkSession, frame: DataFrame, last: str | None) -> tuple[bool, str]:
    """Whether the files that a frame reads are those of the stamp before, and their stamp: nothing to catch up with."""
    now = storage.stamp(spark, frame)
    return now == last, now


def run(spark: SparkSession, inbox: str, store: str, checkpoint: str, as_of: str) -> None:
    """Promotes all waiting request files (JSON, one request each) and publishes notes and seen keys; bad files go to `rejected`.

    Notes and keys are published together, and the keys have the batch's number: a batch that is run again after that
    finds its number and ends; one that is run again before that starts from the tables of before. Archive rows and
    rejected files may be there twice then, with equal content.
    """

    def batch(frame: DataFrame, number: int) -> None:
        seen = S.published(spark, store, "seen")
        if seen.where(F.col("batch") == number).head(1):
            return
        requests, rejected = decode(frame.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("content")))
        notes, keys, archive = promote(S.published(spark, store, "notes"), requests, seen, as_of)
        rejected.write.mode("append").json(f"{store}/rejected")
        S.append_archive(archive, f"{store}/archive")
        mark = spark.createDataFrame([(f"batch-{number}", None, number)], seen.schema)
        kept = expired(seen.where("seen IS NOT NULL"), as_of).unionByName(seen.where("seen IS NULL"))
        S.publish({"notes": notes, "seen": kept.unionByName(keys.withColumn("batch", F.lit(number).cast("long"))).unionByName(mark)}, store)

    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.json").schema("path string, modificationTime timestamp, length long, content binary").load(inbox).select("path", "content")
    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def begin(notes: DataFrame, store: str) -> None:
    """An inbox's first state: the notes as they are, and no keys."""
    S.publish({"notes": notes, "seen": notes.sparkSession.createDataFrame([], "key string, seen date, batch long")}, store)
