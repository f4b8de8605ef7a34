"""Registered neighbour, graph and lifecycle queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.functions import fingerprints as H
from tessella.operators import duplicates as D
from tessella.operators import graph as G
from tessella.operators import lifecycle as L
from tessella.operators import neighbours as N
from tessella.plans.common import AS_OF, LIVE_SQL, NOTES_SQL, TOKENS_SQL, notes, table
from tessella.plans.rules import EDGES_SQL, edges


def exact_dup(spark, sf_dir):
    return N.exact_bodies(notes(spark, sf_dir))


def duplicate_candidates(spark, sf_dir):
    return D.candidates(notes(spark, sf_dir)).select("left", "right", "narrow", "sketched", "shared", "distance", "place")


def trigram_pairs(spark, sf_dir):
    """Similarities of all candidates at the warn line or with equal bodies."""
    return D.compared(notes(spark, sf_dir), units=False).where((F.col("raw") >= D.WARN) | F.col("same")).select("left", "right", F.col("raw").alias("score"), "same")


def duplicate_findings(spark, sf_dir):
    """C01-C03, C05, C08, C13, C17, C19, C20, counted by rule; `ing` and `version` stand for words of change."""
    return D.store_findings(notes(spark, sf_dir), AS_OF)


def simhash_fnv(spark, sf_dir):
    return notes(spark, sf_dir).select("id", H.simhash(X.similarity_normal(F.concat_ws(" ", "summary", "title"))).alias("fp"))


def simhash_bands_md5(spark, sf_dir):
    n = notes(spark, sf_dir).select("id", N.simhash_md5(F.col("summary")).alias("fp"))
    pairs = N.band_pairs(n, N.bands(F.col("fp")))
    a, b = n.toDF("left", "x"), n.toDF("right", "y")
    return pairs.join(a, "left").join(b, "right").select("left", "right", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).alias("distance"))


def unit_sketch_pairs(spark, sf_dir):
    """Best unit alignments of candidates that share a sketch value."""
    return D.compared(notes(spark, sf_dir)).where("best > 0").select("left", "right", "best", F.col("pairs").alias("close"))


def rival_notes(spark, sf_dir):
    return D.rivals(notes(spark, sf_dir), P.is_live(AS_OF)).select("rule", "id", F.col("related")[0].cast("long").alias("rival"))


def decision_gate(spark, sf_dir):
    n = notes(spark, sf_dir)
    return D.decision_gate(n.where("id % 100 = 4"), n, AS_OF)


def link_candidates(spark, sf_dir):
    return N.link_candidates(notes(spark, sf_dir))


def notation_drift(spark, sf_dir):
    return N.notation_drift(notes(spark, sf_dir))


def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return N.cosine_topk(v, v.where("id % 100 = 0").toDF("query", "q"), 5)


def reverse_refs(spark, sf_dir):
    return G.used_by(edges(spark, sf_dir), notes(spark, sf_dir))


def chain_components(spark, sf_dir):
    return G.chains(notes(spark, sf_dir))


def gc_plan(spark, sf_dir):
    return L.gc_plan(notes(spark, sf_dir), edges(spark, sf_dir), AS_OF)


def retired_unfolded(spark, sf_dir):
    return L.retired(notes(spark, sf_dir), AS_OF)


def cards(spark, sf_dir):
    n = notes(spark, sf_dir)
    # groups of eight facts of a scope and month, in order of id, so that groups stay small at any size
    place = F.row_number().over(Window.partitionBy("scope", F.date_format("created", "yyyy-MM")).orderBy("id")) - 1
    named = F.concat_ws("/", "scope", F.date_format("created", "yyyy-MM"), F.floor(F.col("place") / 8).cast("string"))
    groups = n.where("type = 'fact'").withColumn("place", place).select(named.alias("group"), "id")
    return L.cards(groups, n).select("group", "members", F.md5("body").alias("body_md5"), F.array_join("tags", " ").alias("tags"))


def migrate_plan(spark, sf_dir):
    return L.migrate_plan(notes(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        exact_dup, duplicate_candidates, trigram_pairs, duplicate_findings, simhash_fnv, simhash_bands_md5, unit_sketch_pairs, rival_notes, decision_gate, link_candidates, notation_drift, cosine_topk, reverse_refs, chain_components, gc_plan, retired_unfolded, cards,
        migrate_plan,
    )
}


def _norm_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '(\d),(\d{{3}})', '\1\2', 'g'), '[^\p{{L}}\p{{Nd}}]+', '', 'g')"


def _grams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 2, 1) + 1), lambda i: substring({x}, i, 3)))"


def _jaccard_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0)"


_UNITS_SQL = rf"list_filter(list_transform(flatten(list_transform(string_split(whole, chr(10)), lambda l: string_split(regexp_replace(ltrim(trim(replace(l, '|', ' '), chr(32) || chr(9) || chr(13)), '#>-*+ ' || chr(9)), '\.([ \t]|$)', chr(1) || '\1', 'g'), chr(1)))), lambda u: trim(u, chr(32) || chr(9) || chr(13))), lambda u: u <> '')"
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, {x}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_BYTES = "list_transform(range(1, octet_length(encode(gram)) + 1), lambda i: ('0x' || substring(hex(encode(gram)), (2 * i - 1)::INT, 2))::INT::HUGEINT)"
_RUNES = "list_transform(range(1, length(gram) + 1), lambda i: unicode(substring(gram, i::INT, 1))::HUGEINT)"


def _print_sql(name: str, text: str, of: str = "base") -> str:
    """(id, fp UBIGINT): fingerprints of `text` of the table `of`, by FNV-1a over all 3-grams."""
    bits = " + ".join(f"CASE WHEN sum(CASE WHEN (h // {1 << i}::HUGEINT) % 2 = 1 THEN c ELSE -c END) > 0 THEN {1 << i}::HUGEINT ELSE 0::HUGEINT END" for i in range(64))
    return f"""{name}_t AS (SELECT id, trim({text}) AS t FROM {of}),
        {name}_g AS (SELECT id, gram, count(*) AS c FROM (SELECT id, substring(t, unnest(range(1, length(t) - 1))::INT, 3) AS gram FROM {name}_t WHERE length(t) >= 3) GROUP BY id, gram),
        {name}_h AS (SELECT gram, {_FNV.format(x=_BYTES)} AS h FROM (SELECT DISTINCT gram FROM {name}_g)),
        {name}_f AS (SELECT id, {bits} AS fp FROM {name}_g JOIN {name}_h USING (gram) GROUP BY id),
        {name} AS (SELECT b.id, coalesce(fp, 0)::UBIGINT AS fp FROM {of} b LEFT JOIN {name}_f USING (id))"""


_BASE_SQL = f"base AS (SELECT id, scope, tags, body, coalesce(title, '') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(body, '') AS whole, {_norm_sql("coalesce(summary, '') || ' ' || coalesce(title, '')")} AS hn, {_norm_sql("coalesce(body, '')")} AS bn FROM notes)"
_CANDIDATES_SQL = f"""{_BASE_SQL}, {_print_sql('fp', "hn || ' ' || bn")}, {_print_sql('sfp', 'hn')},
    u0 AS (SELECT id, i, {_norm_sql('u')} AS unit FROM (SELECT id, us, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (SELECT id, {_UNITS_SQL} AS us FROM base))),
    u1 AS (SELECT id, unit, min(i) AS i FROM u0 WHERE length(unit) >= 12 GROUP BY id, unit),
    u2 AS (SELECT id, unit, {_grams_sql('unit')} AS g FROM u1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY len({_grams_sql('unit')}) DESC, i) <= 48),
    u3 AS (SELECT id, unit, unnest(g) AS gram FROM u2), uh AS (SELECT gram, {_FNV.format(x=_RUNES)} AS h FROM (SELECT DISTINCT gram FROM u3)),
    sk AS (SELECT DISTINCT id, h FROM (SELECT id, unit, h FROM u3 JOIN uh USING (gram) QUALIFY row_number() OVER (PARTITION BY id, unit ORDER BY h) <= 8)),
    k AS (SELECT id, 'band' || j AS kind, ((fp >> (16 * j)) & 65535)::VARCHAR AS value FROM fp, range(0, 4) r(j) UNION ALL SELECT id, 'head' || j, ((fp >> (16 * j)) & 65535)::VARCHAR FROM sfp, range(0, 4) r(j)
      UNION ALL SELECT id, 'scope', scope FROM base WHERE scope IS NOT NULL UNION ALL SELECT id, 'tag', unnest(list_distinct(list_transform(tags, lambda t: lower(t)))) FROM base UNION ALL SELECT id, 'sketch', h::VARCHAR FROM sk),
    good AS (SELECT kind, value FROM k GROUP BY kind, value HAVING count(*) BETWEEN 2 AND 2000),
    kk AS (SELECT k.* FROM k JOIN good USING (kind, value)),
    met AS (SELECT a.id AS l, b.id AS r, bool_or(NOT (a.kind LIKE 'head%' OR a.kind = 'sketch')) AS narrow, bool_or(a.kind = 'sketch') AS sketched FROM kk a JOIN kk b ON a.kind = b.kind AND a.value = b.value AND a.id <> b.id GROUP BY 1, 2),
    ranked AS (SELECT l, r, narrow, sketched, len(list_intersect(list_transform(a.tags, lambda t: lower(t)), list_transform(b.tags, lambda t: lower(t))))::INT AS shared, bit_count(xor(x.fp, y.fp))::INT AS distance
      FROM met JOIN base a ON l = a.id JOIN base b ON r = b.id JOIN fp x ON l = x.id JOIN fp y ON r = y.id),
    cand AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY sketched DESC, shared DESC, distance, r) AS place FROM ranked QUALIFY place <= 50)"""

SQL = {
    "exact_dup": f"WITH {NOTES_SQL}, f AS (SELECT id, md5({_norm_sql('body')}) AS key FROM notes), g AS (SELECT key, min(id) AS first FROM f GROUP BY key HAVING count(*) > 1) SELECT id, first FROM f JOIN g USING (key) WHERE id > first",
    "duplicate_candidates": f"""WITH {NOTES_SQL}, {_CANDIDATES_SQL} SELECT l AS "left", r AS "right", narrow, sketched, shared, distance, place FROM cand""",
    "simhash_fnv": f"""WITH {NOTES_SQL}, {_BASE_SQL}, {_print_sql('sfp', 'hn')} SELECT id, CASE WHEN fp >= 9223372036854775808 THEN (fp::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE fp::BIGINT END AS fp FROM sfp""",
    "trigram_pairs": f"""WITH {NOTES_SQL}, {_CANDIDATES_SQL},
        f AS (SELECT id, tags, scope, bn, CASE WHEN hn = '' THEN [] ELSE {_grams_sql('hn')} END AS gh, CASE WHEN bn = '' THEN [] ELSE {_grams_sql('bn')} END AS gb FROM base),
        s AS (SELECT l, r, a.bn = b.bn AND a.bn <> '' AS same, 0.45::DOUBLE * {_jaccard_sql('a.gh', 'b.gh')} + 0.35::DOUBLE * {_jaccard_sql('a.gb', 'b.gb')} AS content,
          0.15::DOUBLE * {_jaccard_sql('a.tags', 'b.tags')} + CASE WHEN a.scope = b.scope THEN 0.05::DOUBLE ELSE 0 END AS side FROM cand JOIN f a ON l = a.id JOIN f b ON r = b.id),
        t AS (SELECT l AS "left", r AS "right", round(content + side * content / 0.8::DOUBLE, 9) AS score, same FROM s) SELECT * FROM t WHERE score >= 0.06 OR same""",
    "simhash_bands_md5": f"""WITH {NOTES_SQL}, g AS (SELECT id, unnest({_grams_sql('n')}) AS gram FROM (SELECT id, {_norm_sql('summary')} AS n FROM notes)),
        m AS (SELECT id, ('0x' || left(md5(gram), 16))::UBIGINT AS h FROM g WHERE gram <> ''),
        b AS (SELECT id, i, count(*) FILTER ((h >> i) & 1 = 1) * 2 > count(*) AS bit FROM m, range(0, 64) r(i) GROUP BY id, i),
        f AS (SELECT id, sum(CASE WHEN bit THEN 1::UBIGINT << i ELSE 0 END)::UBIGINT AS fp FROM b GROUP BY id),
        e AS (SELECT notes.id, coalesce(fp, 0::UBIGINT) AS fp FROM notes LEFT JOIN f USING (id)),
        k AS (SELECT id, fp, j, (fp >> (16 * j)) & 65535 AS key FROM e, range(0, 4) r(j)),
        good AS (SELECT j, key FROM k GROUP BY j, key HAVING count(*) BETWEEN 2 AND 2000)
        SELECT DISTINCT a.id AS "left", b.id AS "right", bit_count(xor(a.fp, b.fp)::UBIGINT)::INT AS distance FROM k a JOIN k b ON a.j = b.j AND a.key = b.key AND a.id < b.id WHERE (a.j, a.key) IN (SELECT (j, key) FROM good)""",
    "rival_notes": f"""WITH {NOTES_SQL}, n AS (SELECT * FROM notes WHERE {LIVE_SQL} AND type = 'decision'),
        b AS (SELECT a.id, a.created, b.id AS rival, b.created AS since FROM n a JOIN n b ON a.scope = b.scope AND a.id <> b.id AND list_has_any(a.tags, b.tags) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.created DESC, b.id DESC) = 1)
        SELECT 'C05' AS rule, id, rival FROM b UNION ALL SELECT 'C08', id, rival FROM b WHERE since > created OR (since = created AND rival > id)""",
    "decision_gate": f"""WITH {NOTES_SQL}, h AS (SELECT id, type, scope, tags, {LIVE_SQL} AS live, {_norm_sql("coalesce(nullif(title, ''), left(summary, 40)) || ' ' || summary")} AS n FROM notes WHERE type = 'decision'),
        g AS (SELECT *, {_grams_sql('n')} AS g FROM h), m AS (SELECT a.id, b.id AS rival, round({_jaccard_sql('a.g', 'b.g')}, 9) AS similarity FROM g a JOIN g b ON a.id % 100 = 4 AND b.live AND a.scope = b.scope AND a.id <> b.id
          AND len(list_distinct(list_intersect(a.tags, b.tags))) >= 2)
        SELECT id, rival, similarity FROM m WHERE similarity >= 0.04 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, rival) = 1""",
    "link_candidates": f"""WITH {NOTES_SQL}, f AS (SELECT id, tags, scope, created, list_distinct({TOKENS_SQL('title')}) AS words, list_distinct(list_filter({TOKENS_SQL("title || ' ' || summary")}, lambda w: length(w) >= 4 AND regexp_matches(w, '^[a-z0-9]*[a-z][a-z0-9]*$'))) AS ids FROM notes),
        k AS (SELECT id, 'i|' || scope || '|' || unnest(ids) AS key FROM f UNION ALL SELECT id, 't|' || unnest(list_distinct(tags)) FROM f), good AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 300),
        p AS (SELECT DISTINCT x.id AS l, y.id AS r FROM k x JOIN k y ON x.key = y.key AND x.id < y.id WHERE x.key IN (SELECT key FROM good)),
        s AS (SELECT l, r, round(CASE len(list_intersect(a.tags, b.tags)) WHEN 2 THEN 1.0::DOUBLE WHEN 1 THEN 0.4 ELSE 0 END + CASE WHEN abs(a.created - b.created) <= 7 THEN 0.3::DOUBLE ELSE 0 END
            + 0.5::DOUBLE * (0.5 * {_jaccard_sql('a.tags', 'b.tags')} + 0.3 * {_jaccard_sql('a.words', 'b.words')} + CASE WHEN a.scope = b.scope THEN 0.2::DOUBLE ELSE 0 END)
            + CASE WHEN a.scope = b.scope THEN 0.2::DOUBLE + CASE WHEN list_has_any(a.ids, b.ids) THEN 0.8::DOUBLE ELSE 0 END ELSE 0 END, 9) AS score FROM p JOIN f a ON l = a.id JOIN f b ON r = b.id),
        e AS (SELECT l AS id, r AS other, score FROM s WHERE score >= 1 UNION ALL SELECT r, l, score FROM s WHERE score >= 1)
        SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM e QUALIFY place <= 5""",
    "notation_drift": rf"""WITH {NOTES_SQL}, v AS (SELECT id, shape, try_cast(replace(shape, ',', '') AS BIGINT) AS value FROM (SELECT id, unnest(list_distinct(regexp_extract_all(body, '\d[\d,]*\d'))) AS shape FROM notes)),
        w AS (SELECT * FROM v WHERE value >= 1000), few AS (SELECT value FROM w GROUP BY value HAVING count(DISTINCT id) <= 200 AND count(DISTINCT shape) > 1)
        SELECT DISTINCT a.id AS "left", b.id AS "right", a.value FROM w a JOIN w b ON a.value = b.value AND a.id < b.id AND a.shape <> b.shape WHERE a.value IN (SELECT value FROM few)""",
    "cosine_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT q.id AS query, v.id, round(list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))), 9) AS cos,
          row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))), 9) DESC, v.id) AS place
        FROM v JOIN v q ON q.id % 100 = 0 AND v.id <> q.id QUALIFY place <= 5""",
    "reverse_refs": f"""WITH {EDGES_SQL} SELECT dst AS id, src AS "user", kind FROM edges WHERE dst IN (SELECT doc_id FROM documents)
        QUALIFY row_number() OVER (PARTITION BY dst, src ORDER BY CASE WHEN kind = 'source' THEN 0 ELSE 1 END) = 1""",
    "chain_components": f"""WITH RECURSIVE {NOTES_SQL}, e AS (SELECT id AS a, superseded_by AS b FROM notes WHERE superseded_by IS NOT NULL UNION SELECT superseded_by, id FROM notes WHERE superseded_by IS NOT NULL),
        r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), m AS (SELECT node, min(root) AS root FROM r GROUP BY node) SELECT root, count(*) AS size FROM m GROUP BY root""",
    "gc_plan": f"""WITH {NOTES_SQL}, {EDGES_SQL}, x AS (SELECT id FROM notes WHERE pinned UNION SELECT dst FROM edges UNION SELECT superseded_by FROM notes WHERE superseded_by IS NOT NULL
          UNION (SELECT id FROM notes WHERE type = 'caution' QUALIFY row_number() OVER (PARTITION BY scope ORDER BY created DESC, id) <= 30))
        SELECT id, DATE '2025-02-10' - created AS age FROM notes WHERE DATE '2025-02-10' - created >= 90 AND type IN ('todo', 'history') AND id NOT IN (SELECT id FROM x WHERE id IS NOT NULL)
        ORDER BY age DESC, id LIMIT greatest(200, (SELECT count(*) FROM notes) * 2 // 100)""",
    "retired_unfolded": f"WITH {NOTES_SQL} SELECT id, superseded_by, invalid_at FROM notes WHERE NOT {LIVE_SQL} AND NOT pinned",
    "cards": f"""WITH {NOTES_SQL}, r AS (SELECT scope || '/' || strftime(created, '%Y-%m') || '/' || ((row_number() OVER (PARTITION BY scope, strftime(created, '%Y-%m') ORDER BY id) - 1) // 8) AS "group", * FROM notes WHERE type = 'fact'),
        c AS (SELECT "group", tag, count(*) AS n FROM (SELECT "group", unnest(tags) AS tag FROM r) GROUP BY "group", tag), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY n DESC, tag) <= 3),
        l AS (SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY id) || '. ' || title || ' [mem:' || id || ']' AS line, id FROM r)
        SELECT l."group", count(*) AS members, md5(string_agg(line, chr(10) ORDER BY id)) AS body_md5, (SELECT string_agg(tag, ' ' ORDER BY n DESC, tag) FROM t WHERE t."group" = l."group") AS tags
        FROM l GROUP BY l."group" HAVING count(*) BETWEEN 3 AND 12""",
    "migrate_plan": f"WITH {NOTES_SQL} SELECT id, 'human' AS author, coalesce(nullif(trim(title), ''), left(summary, 40)) AS title, coalesce(title, '') <> coalesce(nullif(trim(title), ''), left(summary, 40)) AS changed FROM notes",
}
