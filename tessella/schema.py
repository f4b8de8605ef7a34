"""Tables of the engine as DDL schemas, the table of note types, and notes made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2025-02-10"

NOTES = (
    "id string, type string, title string, summary string, body string, tags array<string>, keys array<string>, scope string, author string, "
    "todo_status string, severity string, pinned boolean, importance int, created date, updated_at timestamp, invalid_at date, stale_after date, "
    "superseded_by string, hit_count bigint, last_hit_at timestamp, body_hash string, simhash bigint, state string, archived string, spec int, "
    "review boolean, migrated boolean, origin string, origin_session string, basis_hash string, rev int, card_rule string, obs_stale string, "
    "sources array<string>, links array<string>"
)
POSTINGS = ("field string, term string, id string, tf bigint, pos array<int>")
EDGES = ("src string, dst string, kind string")
HITS = ("cmd string, id string, at timestamp, n bigint")
ARCHIVE = ("op string, id string, path string, archived_at timestamp, markdown string")
FILE_STATE = ("path string, mtime timestamp, size bigint, hash string, indexed_at timestamp")
QUEUE = (
    "session_id string, transcript_path string, reason string, at timestamp, cwd string, offset bigint, covered bigint, done_at timestamp, result string, saved array<string>"
)

#: One row a note type. half_life 0 never fades.
TYPE_SPEC_DDL = (
    "type string, sources string, shape string, half_life double, severity boolean, todo boolean, evidence boolean, conclusion boolean, "
    "one_thing boolean, gate boolean, keep boolean, bonus boolean, stale_days int"
)
TYPE_SPEC = [
    ("todo", "none", "free", 0.0, False, True, False, False, False, False, False, False, 0),
    ("history", "warn", "free", 90.0, False, False, True, False, False, False, False, False, 180),
    ("issue", "required", "issue-sections", 0.0, True, False, True, False, False, False, True, True, 0),
    ("caution", "required", "free", 0.0, True, False, False, False, False, False, True, False, 0),
    ("decision", "required", "free", 720.0, False, False, True, True, True, True, True, True, 1440),
    ("howto", "none", "numbered", 720.0, False, False, True, False, False, False, True, False, 1440),
    ("fact", "required", "free", 0.0, False, False, False, False, True, False, True, False, 360),
    ("observation", "required", "numbered", 0.0, False, False, False, False, False, False, True, False, 0),
]
TYPES = [row[0] for row in TYPE_SPEC]


def type_spec(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """The type table, with rows for user-defined types; small and fixed, so it may be broadcast."""
    own = {row[0]: row for row in [*TYPE_SPEC, *more]}
    return spark.createDataFrame(list(own.values()), TYPE_SPEC_DDL)


def notes_from_documents(documents: DataFrame) -> DataFrame:
    """Notes derived from the documents table by fixed arithmetic on doc_id; a note is superseded only by one that exists.

    The ids of one document in 23 are broadcast (8 bytes each), so that no text is shuffled to learn whether its successor exists.
    """
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int"))
    successors = documents.select((F.col("doc_id") - 1).alias("_before")).where(F.col("_before") % 23 == 0)
    base = documents.join(F.broadcast(successors), F.col("doc_id") == F.col("_before"), "left")
    return base.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int")).alias("type"),
        F.left(F.substring_index("text", "\n", 1), F.lit(40)).alias("title"),
        F.left("text", F.lit(120)).alias("summary"),
        F.col("text").alias("body"),
        F.array("lang", "source").alias("tags"),
        F.col("source").alias("scope"),
        day.alias("created"),
        (F.col("doc_id") % 50 == 0).alias("pinned"),
        (1 + F.col("doc_id") % 5).alias("importance"),
        F.when(F.col("doc_id") % 17 == 0, F.date_add(day, 30)).alias("invalid_at"),
        F.when(F.col("_before").isNotNull(), F.col("doc_id") + 1).alias("superseded_by"),
    )
