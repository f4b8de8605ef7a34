"""Lifecycle of notes: folding plans, retirement, restoring, cards, patches, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.schema import type_spec


def exempt(notes: DataFrame, edges: DataFrame, cautions: int = 30) -> DataFrame:
    """ids that are never folded: pinned, of a kept type that is linked, superseding, or among a scope's newest cautions."""
    newest = Window.partitionBy("scope").orderBy(F.desc("created"), "id")
    fresh = notes.where("type = 'caution'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= cautions).select("id")
    heirs = notes.where("superseded_by is not null").select(F.col("superseded_by").alias("id"))
    return notes.where("pinned").select("id").union(edges.select(F.col("dst").alias("id"))).union(heirs).union(fresh).distinct()


def gc_plan(notes: DataFrame, edges: DataFrame, as_of: str, days: int = 90, least: int = 200) -> DataFrame:
    """(id, age): the oldest foldable notes, max(200, 2 %) of all at most."""
    age = F.datediff(P.day(as_of), "created")
    spec = F.broadcast(type_spec(notes.sparkSession).where("keep").select("type"))
    old = notes.where(age >= days).join(spec, "type", "left_anti").join(exempt(notes, edges), "id", "left_anti")
    n = notes.count()
    return old.select("id", age.alias("age")).orderBy(F.desc("age"), "id").limit(max(least, n * 2 // 100))


def retired(notes: DataFrame, as_of: str) -> DataFrame:
    """Superseded or invalid notes that are not pinned."""
    return notes.where(P.is_dead(as_of) & ~F.col("pinned")).select("id", "superseded_by", "invalid_at")


def compress(body: Column, fold: int = 8) -> Column:
    """Blank runs squeezed, and code blocks of `fold` lines or more folded."""
    folded = F.regexp_replace(body, rf"(?s)```[^\n]*\n(?:[^\n]*\n){{{fold},}}?```", "```\n…\n```")
    return F.regexp_replace(folded, r"\n[ \t]*(\n[ \t]*)+\n", "\n\n")


def archived_last(archive: DataFrame) -> DataFrame:
    """The latest original of each id."""
    return archive.groupBy("id").agg(F.max_by("markdown", "archived_at").alias("markdown"), F.max("archived_at").alias("archived_at"))


def restore(notes: DataFrame, archive: DataFrame, ids: DataFrame) -> DataFrame:
    """notes with the bodies of ids taken back from the archive."""
    back = archived_last(archive).join(ids, "id", "left_semi").select("id", F.col("markdown").alias("_body"))
    return notes.join(back, "id", "left").withColumn("body", F.coalesce("_body", "body")).drop("_body")


def patch(notes: DataFrame, patches: DataFrame, allowed: tuple[str, ...] = ("title", "summary", "scope", "tags", "pinned", "superseded_by", "invalid_at")) -> DataFrame:
    """notes with the non-null fields of patches(id, ...) of the allowed ones put in."""
    fields = [c for c in patches.columns if c in allowed and c in notes.columns]
    p = patches.select("id", *[F.col(c).alias(f"_p_{c}") for c in fields])
    return notes.join(p, "id", "left").select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in notes.columns])


def merge_batch(notes: DataFrame, batch: DataFrame) -> DataFrame:
    """Copy-on-write merge: rows of the batch replace those of equal id."""
    return notes.join(batch.select("id"), "id", "left_anti").unionByName(batch)


def card_staleness(cards: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """(card, reason): missing, superseded or changed basis. cards: (card, basis array, written hash)."""
    parts = cards.select("card", "written", F.explode("basis").alias("id"))
    joined = parts.join(notes.select("id", P.is_dead(as_of).alias("dead"), F.md5("body").alias("part")), "id", "left")
    told = joined.groupBy("card", "written").agg(F.sum(F.col("part").isNull().cast("int")).alias("missing"), F.bool_or(F.coalesce("dead", F.lit(False))).alias("dead"), X.basis_hash(F.collect_list(F.concat_ws(":", "id", "part"))).alias("now"))
    reason = F.when(F.col("missing") > 0, "missing").when(F.col("now") == F.col("written"), "fresh").when(F.col("dead"), "superseded").otherwise("changed")
    return told.select("card", reason.alias("reason"))


def cards(groups: DataFrame, notes: DataFrame) -> DataFrame:
    """A card for each group(group, id): numbered lines with citations, the three commonest tags, and a basis hash."""
    rows = groups.join(notes, "id")
    tags = rows.select("group", F.explode("tags").alias("tag")).groupBy("group", "tag").agg(F.count("*").alias("n"))
    top = tags.groupBy("group").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), 1, 3), lambda x: x["tag"]).alias("tags"))
    items = F.array_sort(F.collect_list(F.struct("id", F.col("title").alias("title"))))
    lines = F.transform(items, lambda x, i: F.concat(i + 1, F.lit(". "), x["title"], F.lit(" [mem:"), x["id"], F.lit("]")))
    body = rows.groupBy("group").agg(F.array_join(lines, "\n").alias("body"), X.basis_hash(F.collect_list(F.concat_ws(":", "id", F.md5("body")))).alias("basis_hash"), F.count("*").alias("members"))
    return body.where((F.col("members") >= 3) & (F.col("members") <= 12)).join(top, "group")


def migrate_plan(notes: DataFrame) -> DataFrame:
    """What version 2 of the record needs: (id, author, title, changed)."""
    title = F.coalesce(F.nullif(F.btrim("title"), F.lit("")), F.left("summary", F.lit(40)))
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit("human")) if "author" in notes.columns else F.lit("human")
    return notes.select("id", author.alias("author"), title.alias("title"), (F.coalesce("title", F.lit("")) != title).alias("changed"))
