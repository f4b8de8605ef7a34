"""Registered queries over the store: lookups, counts, links, vectors, vocabularies, consolidation, lifecycle, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.operators import consolidate as C
from tessella.operators import lookup as L
from tessella.operators import reports as R
from tessella.operators import sinks as S
from tessella.operators import vectors as V
from tessella.operators import vocabulary as W
from tessella.operators.judge import judge
from tessella.plans.common import AS_OF, LIVE_SQL, NOTES_SQL, TOKENS_SQL, notes, table
from tessella.plans.rules import EDGES_SQL, edges, hits


def lookup_ids(spark, sf_dir):
    """Notes that hits name, of the decisions and facts that live."""
    return L.by_ids(notes(spark, sf_dir), hits(spark, sf_dir), P.Narrow(types=("decision", "fact")), AS_OF).select("id", "type", "scope")


def recent_decisions(spark, sf_dir):
    return L.recent(notes(spark, sf_dir), "decision", 50).select("id", "created")


def counts_by_type(spark, sf_dir):
    return L.counts_by(notes(spark, sf_dir), "type")


def store_counts(spark, sf_dir):
    return L.ages(notes(spark, sf_dir), AS_OF, 180)


def link_targets(spark, sf_dir):
    n = notes(spark, sf_dir)
    return L.link_targets(n, edges(spark, sf_dir), n)


def link_pairs(spark, sf_dir):
    return L.link_pairs(edges(spark, sf_dir), notes(spark, sf_dir))


def newest_per_scope(spark, sf_dir):
    return L.newest_per(notes(spark, sf_dir), F.col("scope"))


def live_without_cards(spark, sf_dir):
    return L.without_cards(L.without_retired(notes(spark, sf_dir), AS_OF)).select("id", "type")


def notes_with_hits(spark, sf_dir):
    totals = hits(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return S.with_hits(notes(spark, sf_dir), totals).select("id", "hit_count", "last_hit_at")


def merged_twins(spark, sf_dir):
    """Each note's successor appended to it, as a near twin would be."""
    n = notes(spark, sf_dir)
    more = n.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id"), F.col("id").alias("twin")).join(n.select("id", F.col("summary").alias("body"), "created"), "id")
    out = S.merge_twins(n, more.select("twin", "body", F.lit(None).cast("array<string>").alias("keys"), "created"))
    return out.select("id", F.md5("body").alias("body_md5"))


def vector_store(spark, sf_dir):
    """Vectors as int8 and back: the largest error of each."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.lit("h").alias("hash"))
    back = V.loaded(V.stored(v)).withColumnRenamed("v", "w")
    return v.join(back, "id").select("id", F.round(F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b))), 6).alias("error"))


def vector_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.nearest(v, 64, 3)


def mutual_neighbours(spark, sf_dir):
    return L.mutual_nearest(vector_neighbours(spark, sf_dir).select(F.col("id").alias("left"), F.col("other").alias("right"), F.col("cos").alias("score")))


def tag_drift(spark, sf_dir):
    """Sources as tags, against a vocabulary of four of them."""
    n = notes(spark, sf_dir)
    return W.drift(n, spark.createDataFrame([("en",), ("src1",), ("src10",), ("source",)], "tag string")).select("tag", "notes", F.array_join("near", " ").alias("near"))


def missed_words(spark, sf_dir):
    """Words of user turns, as a log of queries without a hit."""
    return W.missed_words(table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("text").alias("query")), 5)


def link_groups(spark, sf_dir):
    """Groups over edges within a language, as the derived edges hardly ever stay within a source."""
    return C.link_groups(notes(spark, sf_dir).withColumn("scope", F.col("tags")[0]), edges(spark, sf_dir), AS_OF)


def chain_order(spark, sf_dir):
    return C.chain_groups(notes(spark, sf_dir))


def queue_table(spark, sf_dir):
    """Field findings by scope and rule."""
    from tessella.operators.rules import row_findings

    n = notes(spark, sf_dir)
    items = row_findings(n, AS_OF, ["F05", "F06", "B01"]).join(n.select("id", "scope"), "id").select(F.col("rule").alias("kind"), "scope", "id")
    return R.queue_table(items)


def rule_judge(spark, sf_dir):
    """Each note's summary judged against its successor's."""
    n = notes(spark, sf_dir)
    pairs = n.where("superseded_by IS NOT NULL").select("id", F.col("summary").alias("claim"), F.col("superseded_by").alias("next"))
    told = judge(pairs.join(n.select(F.col("id").alias("next"), F.col("summary").alias("evidence")), "next"))
    return told.select("id", "label")


def token_split(spark, sf_dir):
    """How many index tokens each field has."""
    from tessella.operators.index import lengths

    return lengths(notes(spark, sf_dir))


def fold_split(spark, sf_dir):
    """What folding would make of the bodies of retired notes."""
    n = notes(spark, sf_dir)
    out, archive = S.fold_notes(n, n.where(P.is_dead(AS_OF) & ~F.col("pinned")).select("id"), "cold", F.lit(AS_OF).cast("timestamp"))
    return out.join(archive.select("id"), "id", "left_semi").select("id", F.length("body").alias("chars"))


def normal_words(spark, sf_dir):
    """Content words of summaries without particles."""
    return notes(spark, sf_dir).select("id", F.array_join(X.noun_words(F.col("summary")), " ").alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        lookup_ids, recent_decisions, counts_by_type, store_counts, link_targets, link_pairs, newest_per_scope, live_without_cards, notes_with_hits, merged_twins, vector_store, vector_neighbours,
        mutual_neighbours, tag_drift, missed_words, link_groups, chain_order, queue_table, rule_judge, token_split, fold_split, normal_words,
    )
}

_NEAREST = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id, b.id AS other, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS cos FROM v a JOIN v b ON a.id <> b.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) AS place FROM s WHERE cos >= 0 QUALIFY place <= 3)"""

SQL = {
    "lookup_ids": f"WITH {NOTES_SQL} SELECT id, type, scope FROM notes WHERE id IN (SELECT user_id FROM events) AND {LIVE_SQL} AND type IN ('decision', 'fact')",
    "recent_decisions": f"WITH {NOTES_SQL} SELECT id, created FROM notes WHERE type = 'decision' ORDER BY created DESC, id LIMIT 50",
    "counts_by_type": f"WITH {NOTES_SQL} SELECT type AS value, count(*) AS n FROM notes GROUP BY 1",
    "store_counts": f"WITH {NOTES_SQL} SELECT count(*) AS total, count(*) FILTER (DATE '2025-02-10' - created > 180) AS old, count(*) FILTER (pinned) AS pinned, count(*) FILTER (invalid_at <= DATE '2025-02-10') AS invalid FROM notes",
    "link_targets": f"WITH {NOTES_SQL}, {EDGES_SQL} SELECT id FROM notes WHERE id IN (SELECT dst FROM edges UNION SELECT superseded_by FROM notes WHERE superseded_by IS NOT NULL)",
    "link_pairs": f"WITH {EDGES_SQL} SELECT DISTINCT src, dst FROM edges WHERE dst IN (SELECT doc_id FROM documents)",
    "newest_per_scope": f"WITH {NOTES_SQL} SELECT scope AS key, id FROM notes QUALIFY row_number() OVER (PARTITION BY scope ORDER BY created DESC, id DESC) = 1",
    "live_without_cards": f"WITH {NOTES_SQL} SELECT id, type FROM notes WHERE {LIVE_SQL} AND type <> 'observation'",
    "notes_with_hits": "SELECT doc_id AS id, count(user_id) AS hit_count, max(ts) AS last_hit_at FROM documents LEFT JOIN events ON user_id = doc_id GROUP BY doc_id",
    "merged_twins": f"""WITH {NOTES_SQL} SELECT a.id, md5(CASE WHEN b.id IS NOT NULL AND len(string_split(a.body, chr(10))) <= 120 THEN a.body || chr(10) || chr(10) || '## ' || b.created::VARCHAR || chr(10) || chr(10) || b.summary ELSE a.body END) AS body_md5
        FROM notes a LEFT JOIN notes b ON a.superseded_by = b.id""",
    "vector_store": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS s FROM embeddings)
        SELECT id, round(list_max(list_transform(v, lambda x: abs(x - round(x / s) * s))), 6) AS error FROM v""",
    "vector_neighbours": f"WITH {_NEAREST} SELECT id, other, cos, place FROM k",
    "mutual_neighbours": f"WITH {_NEAREST} SELECT a.id AS \"left\", a.other AS \"right\", a.cos AS score FROM k a JOIN k b ON a.place = 1 AND b.place = 1 AND a.other = b.id AND b.other = a.id WHERE a.id < a.other",
    "tag_drift": f"""WITH {NOTES_SQL}, std AS (SELECT unnest(['en', 'src1', 'src10', 'source']) AS near), t AS (SELECT tag, count(*) AS notes FROM (SELECT unnest(list_distinct(tags)) AS tag FROM notes) WHERE tag NOT IN (SELECT near FROM std) GROUP BY tag),
        m AS (SELECT tag, notes, near, levenshtein(tag, near) AS d FROM t, std WHERE left(tag, 2) = left(near, 2)),
        g AS (SELECT * FROM m WHERE contains(tag, near) OR contains(near, tag) OR d * 3 <= greatest(length(tag), length(near)) OR left(tag, ceil(greatest(length(tag), length(near)) / 2.0)::INT) = left(near, ceil(greatest(length(tag), length(near)) / 2.0)::INT)),
        r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY d, near) AS place FROM g QUALIFY place <= 3)
        SELECT tag, any_value(notes) AS notes, string_agg(near, ' ' ORDER BY place) AS near FROM r GROUP BY tag""",
    "missed_words": f"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter({TOKENS_SQL('text')}, lambda w: length(w) >= 2)) AS word FROM conversations WHERE role = 'user') GROUP BY word HAVING count(*) >= 5",
    "link_groups": f"""WITH RECURSIVE {NOTES_SQL}, {EDGES_SQL}, live AS (SELECT id, tags[1] AS scope FROM notes WHERE {LIVE_SQL} AND type <> 'observation'),
        e AS (SELECT src AS a, dst AS b FROM edges JOIN live x ON src = x.id JOIN live y ON dst = y.id AND x.scope = y.scope WHERE src <> dst), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS node, a AS root FROM w UNION SELECT w.b, r.root FROM r JOIN w ON w.a = r.node), m AS (SELECT node AS id, min(root) AS "group" FROM r GROUP BY node)
        SELECT "group", id FROM m QUALIFY count(*) OVER (PARTITION BY "group") BETWEEN 3 AND 12""",
    "chain_order": f"""WITH RECURSIVE {NOTES_SQL}, e AS (SELECT id AS a, superseded_by AS b FROM notes WHERE superseded_by IS NOT NULL),
        r AS (SELECT b AS "group", b AS id, 0 AS hops FROM e WHERE b NOT IN (SELECT a FROM e) UNION SELECT r."group", e.a, hops + 1 FROM r JOIN e ON e.b = r.id) SELECT DISTINCT "group", id, hops FROM r""",
    "queue_table": f"""WITH {NOTES_SQL}, f AS (SELECT 'F05' AS kind, scope, id FROM notes WHERE NOT length(summary) BETWEEN 30 AND 120 UNION ALL SELECT 'F06', scope, id FROM notes WHERE NOT length(title) BETWEEN 6 AND 40 OR starts_with(title, left(summary, 20))
          UNION ALL SELECT 'B01', scope, id FROM notes WHERE len(list_filter(string_split(body, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT starts_with(trim(x, ' '), '#'))) < 3)
        SELECT scope, kind, count(DISTINCT id) AS notes FROM f GROUP BY 1, 2 UNION ALL SELECT '*', kind, count(DISTINCT id) FROM f GROUP BY kind""",
    "token_split": f"""WITH {NOTES_SQL} SELECT id, len({TOKENS_SQL('title')}) AS title, len({TOKENS_SQL("array_to_string(list_sort(tags), ' ') || ' ' || scope")}) AS meta, len({TOKENS_SQL('summary')}) AS summary, len({TOKENS_SQL('body')}) AS body FROM notes""",
    "fold_split": f"WITH {NOTES_SQL} SELECT id, length(split_part(body, chr(10) || chr(10), 1))::INT AS chars FROM notes WHERE NOT {LIVE_SQL} AND NOT pinned",
    "normal_words": f"WITH {NOTES_SQL} SELECT id, array_to_string(list_filter(regexp_extract_all(lower(summary), '[가-힣]+|[a-z0-9]+'), lambda w: length(w) >= 3), ' ') AS words FROM notes",
}
