"""Lookups, counts and set differences over a store of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import predicates as P


def by_ids(notes: DataFrame, ids: DataFrame, narrow: P.Narrow | None = None, as_of: str | None = None) -> DataFrame:
    """Notes of a candidate set ids(id) that the filter admits; repeated candidates count once."""
    found = notes.join(ids.select("id").distinct(), "id", "left_semi")
    return found.where(P.where_of(narrow, as_of)) if narrow is not None else found


def by_id(notes: DataFrame, key) -> DataFrame:
    """The note of one id, or no row."""
    return notes.where(F.col("id") == F.lit(key))


def recent(notes: DataFrame, kind: str, n: int) -> DataFrame:
    """The n newest notes of a type; ties by id."""
    return notes.where(F.col("type") == kind).orderBy(F.desc("created"), "id").limit(n)


def with_hashes(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes with the hash of their file, null where the file is not known. files(path, hash)."""
    return notes.join(files.select(F.col("path").alias("_path"), F.col("hash").alias("file_hash")), F.col("path") == F.col("_path"), "left").drop("_path")


def link_documents(notes: DataFrame) -> DataFrame:
    """What linking reads of notes that are neither cards nor archived."""
    live = notes.where((F.col("type") != "observation") & (F.coalesce(F.col("archived"), F.lit("")) == "")) if "archived" in notes.columns else notes.where("type <> 'observation'")
    return live.select("id", "type", "title", "summary", "tags", "scope", "created", *[c for c in ("sources", "links") if c in notes.columns])


def link_pairs(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, dst) of edges whose ends are both in the store."""
    end = lambda c: notes.select(F.col("id").alias(c))
    return edges.select("src", "dst").join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select("src", "dst").distinct()


def link_targets(notes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of the asked ids that a link or a supersession points to."""
    pointed = edges.select(F.col("dst").alias("id")).union(notes.where("superseded_by is not null").select(F.col("superseded_by").alias("id"))).distinct()
    return ids.select("id").distinct().join(pointed, "id", "left_semi")


def linked_to(edges: DataFrame, notes: DataFrame, target) -> DataFrame:
    """(id) of notes that refer to one id, by an edge or as its superseder's predecessor."""
    by_edge = edges.where(F.col("dst") == F.lit(target)).select(F.col("src").alias("id"))
    return by_edge.union(notes.where(F.col("superseded_by") == F.lit(target)).select("id")).distinct()


def visible_basis(cards: DataFrame, notes: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(card, basis): ids and titles of each card's basis notes that exist and are not held. cards(card, basis array)."""
    parts = cards.select("card", F.explode("basis").alias("id")).join(notes.select("id", "title"), "id")
    if held is not None:
        parts = parts.join(held.select("id"), "id", "left_anti")
    return parts.groupBy("card").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("basis"))  # twelve notes a card


def count_where(notes: DataFrame, condition: Column) -> DataFrame:
    return notes.agg(F.count_if(condition).alias("n"))


def counts_by(notes: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column's values, nulls left out, most frequent first."""
    return notes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def ages(notes: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: total, notes older than so many days, pinned ones, invalid ones."""
    age = F.datediff(P.day(as_of), "created")
    return notes.agg(F.count("*").alias("total"), F.count_if(age > days).alias("old"), F.count_if("pinned").alias("pinned"), F.count_if(F.col("invalid_at") <= P.day(as_of)).alias("invalid"))


def without_retired(notes: DataFrame, as_of: str) -> DataFrame:
    return notes.where(P.is_live(as_of) & (F.coalesce(F.col("state"), F.lit("")) != "cold") if "state" in notes.columns else P.is_live(as_of))


def without_cards(notes: DataFrame) -> DataFrame:
    return notes.where("type <> 'observation'")


def auto_notes(notes: DataFrame, origin: str = "auto", session: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Notes that a session wrote by itself: by origin, session and half-open days."""
    out = notes.where(F.col("origin") == origin)
    out = out.where(F.col("origin_session") == session) if session else out
    out = out.where(F.col("created") >= P.day(since)) if since else out
    return out.where(F.col("created") < P.day(until)) if until else out


def in_scopes(notes: DataFrame, scopes: list[str]) -> DataFrame:
    """Notes of the scopes; an empty list admits all."""
    return notes.where(F.col("scope").isin(*scopes)) if scopes else notes


def split_held(held: DataFrame, undone: DataFrame) -> DataFrame:
    """One row: held, and those of them that were undone. held(id), undone(id)."""
    marked = held.select("id").distinct().join(undone.select(F.col("id").alias("_u")).distinct(), F.col("id") == F.col("_u"), "left")
    return marked.agg(F.count("*").alias("held"), F.count("_u").alias("undone"))


def newest_per(notes: DataFrame, key: Column) -> DataFrame:
    """(key, id) of the newest note of each key."""
    return notes.groupBy(key.alias("key")).agg(F.max(F.struct("created", "id")).alias("n")).select("key", F.col("n.id").alias("id"))


def mutual_nearest(scores: DataFrame) -> DataFrame:
    """(left, right, score), left < right: pairs that are each other's first. scores(left, right, score) in both directions."""
    place = F.row_number().over(Window.partitionBy("left").orderBy(F.desc("score"), "right"))
    first = scores.withColumn("n", place).where("n = 1").select("left", "right", "score")
    back = first.select(F.col("left").alias("r"), F.col("right").alias("l"))
    return first.join(back, (F.col("left") == F.col("l")) & (F.col("right") == F.col("r")), "left_semi").where("left < right")
