"""Registered retrieval queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.operators import retrieve as R
from tessella.plans.common import AS_OF, LIVE_SQL, NOTES_SQL, TOKENS_SQL, index, notes, table
from tessella.plans.rules import edges

TERMS = ["license", "und", "les"]
MORE = ["version", "public", "rights"]
BODY = {"body": 1.0}


def bm25_top10(spark, sf_dir):
    return R.top(R.bm25(index(spark, sf_dir), TERMS, BODY).select("id", "score"), 10)


def bm25f_fields(spark, sf_dir):
    return R.top(R.bm25(index(spark, sf_dir), TERMS).select("id", "score", "hits"), 50)


def rrf_two_lists(spark, sf_dir):
    i = index(spark, sf_dir)
    lists = [R.ranked(R.bm25(i, TERMS, BODY), "word", 1.0), R.ranked(R.bm25(i, MORE, BODY), "synonym", 0.5)]
    return R.fuse(lists)


def coverage_gate(spark, sf_dir):
    return R.coverage(index(spark, sf_dir), ["license", "version", "apache", "gnu", "unseenword"])


def phrase_docs(spark, sf_dir):
    n, b = notes(spark, sf_dir), table(spark, sf_dir, "benchmark")
    first = F.substring_index(F.col("text"), ".", 1)
    asked = b.select("item_id", first.alias("phrase")).where(F.length("phrase") >= 20)
    return R.phrase_documents(index(spark, sf_dir), n, asked)


def tag_scope_rank(spark, sf_dir):
    return R.tag_scope_rank(notes(spark, sf_dir), ["de", "src3"]).orderBy(F.desc("created"), "id").limit(50)


def like_head_rank(spark, sf_dir):
    return R.top(R.like_head(notes(spark, sf_dir), "ver"), 50, F.desc("score"), F.desc("created"), F.asc("id"))


def filter_list(spark, sf_dir):
    narrow = P.Narrow(types=("decision", "fact", "howto"), tags=("en",), since="2024-03-01", until="2024-12-01")
    return notes(spark, sf_dir).where(P.where_of(narrow, AS_OF)).select("id", "type", "scope", "created")


def final_score_decay(spark, sf_dir):
    n = notes(spark, sf_dir)
    ranks = R.ranked(R.bm25(index(spark, sf_dir), TERMS, BODY), "word", 1.0)
    rows = n.join(F.broadcast(R.fuse([ranks])), "id")  # at most 50 rows
    return R.final_score(rows, AS_OF, F.lit(0), boost_scope="src3").select("id", "rrf", "bonus", F.round("decay", 9).alias("decay"), "trust", "score")


def facet_scope(spark, sf_dir):
    return R.facet(notes(spark, sf_dir), "scope")


def facet_tag(spark, sf_dir):
    return R.facet(notes(spark, sf_dir).where(P.is_live(AS_OF)), "tag")


def vocab_prefix(spark, sf_dir):
    return R.vocab_prefix(index(spark, sf_dir), "ver", 20)


def zero_hit_explain(spark, sf_dir):
    return R.explain_empty(index(spark, sf_dir), ["license", "the", "qqqq", "apache", "unseenword"])


def context_block(spark, sf_dir):
    return R.context_block(notes(spark, sf_dir), AS_OF, "src0", budget=300)


def search_ladder(spark, sf_dir):
    """Every rung of the ladder for one query: what each note's first rung and rank are."""
    n = notes(spark, sf_dir)
    query = R.parse_query("apache license nowhere", AS_OF)
    return R.rungs(index(spark, sf_dir), n.where(P.where_of(query.narrow, AS_OF)), query, {"license": ["licensed"]})


def search_reranked(spark, sf_dir):
    """The flagship: ladder, final scores, diversity, neighbour lifts and topics."""
    return R.search(index(spark, sf_dir), notes(spark, sf_dir), "apache license nowhere", AS_OF, limit=20, synonyms={"license": ["licensed"]}, edges=edges(spark, sf_dir))


def search_index(spark, sf_dir):
    """Postings with counts of all fields, as the index has them."""
    return index(spark, sf_dir)._postings.select("term", "id", *[F.col(f"tf_{f}").alias(f) for f in ("title", "meta", "summary", "body")])


def token_budget(spark, sf_dir):
    n = notes(spark, sf_dir)
    return n.select("id", X.token_estimate(F.col("body")).alias("tokens"), F.length(X.within_budget(F.col("body"), 200)).alias("prefix"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_top10, bm25f_fields, rrf_two_lists, coverage_gate, phrase_docs, tag_scope_rank, like_head_rank, filter_list, final_score_decay, facet_scope, facet_tag,
        vocab_prefix, zero_hit_explain, context_block, search_ladder, search_reranked, search_index, token_budget,
    )
}


def _bm25_sql(terms: list[str], name: str = "scored") -> str:
    return f"""{name} AS (
      WITH t AS (SELECT id, {TOKENS_SQL('body')} AS toks FROM notes),
      s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
      p AS (SELECT id, len(toks) AS dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, (SELECT unnest({terms!r}) AS term)),
      q AS (SELECT * FROM p WHERE tf > 0),
      d AS (SELECT term, count(*) AS df FROM q GROUP BY term)
      SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.6 + 0.4 * dl / avgdl))), 9) AS score
      FROM q JOIN d USING (term), s GROUP BY id)"""


_FIELDS_SQL = {"title": "title", "meta": "array_to_string(list_sort(tags), ' ') || ' ' || scope", "summary": "summary", "body": "body"}
_BM25F_SQL = f"""WITH {NOTES_SQL},
  t AS (SELECT id, {', '.join(f"{TOKENS_SQL(x)} AS {f}" for f, x in _FIELDS_SQL.items())} FROM notes),
  s AS (SELECT count(*) AS n, {', '.join(f'avg(len({f})) AS avg_{f}' for f in _FIELDS_SQL)} FROM t),
  p AS (SELECT id, term, {', '.join(f'len({f}) AS len_{f}, len(list_filter({f}, lambda x: x = term)) AS tf_{f}' for f in _FIELDS_SQL)} FROM t, (SELECT unnest({TERMS!r}) AS term)),
  q AS (SELECT * FROM p WHERE tf_title + tf_meta + tf_summary + tf_body > 0),
  d AS (SELECT term, count(*) AS df FROM q GROUP BY term)
  SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (
    {' + '.join(f'CASE WHEN tf_{f} > 0 THEN {w} * tf_{f} * 2.2 / (tf_{f} + 1.2 * (0.6 + 0.4 * len_{f} / avg_{f})) ELSE 0 END' for f, w in zip(_FIELDS_SQL, (12.0, 3.0, 4.0, 1.0), strict=True))})), 9) AS score,
    count(*) AS hits
  FROM q JOIN d USING (term), s GROUP BY id ORDER BY score DESC, id LIMIT 50"""
_HALF = "CASE type WHEN 'history' THEN 90.0 WHEN 'decision' THEN 720.0 WHEN 'howto' THEN 720.0 END"
_EST = r"ceil(((length({x}) - length(regexp_replace({x}, '[\p{{Hangul}}\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]', '', 'g'))) * 72 + length(regexp_replace({x}, '[\p{{Hangul}}\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]', '', 'g')) * 30) / 100.0)::BIGINT"

_LADDER_PART = f"greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * ({' + '.join(f'CASE WHEN tf_{f} > 0 THEN {w} * tf_{f} * 2.2 / (tf_{f} + 1.2 * (0.6 + 0.4 * len_{f} / avg_{f})) ELSE 0 END' for f, w in zip(_FIELDS_SQL, (12.0, 3.0, 4.0, 1.0), strict=True))})"
_LADDER_SQL = f"""WITH {NOTES_SQL},
  t AS (SELECT id, {', '.join(f"{TOKENS_SQL(x)} AS {f}" for f, x in _FIELDS_SQL.items())} FROM notes),
  s AS (SELECT count(*) AS n, {', '.join(f'avg(len({f})) AS avg_{f}' for f in _FIELDS_SQL)} FROM t),
  p AS (SELECT id, term, {', '.join(f'len({f}) AS len_{f}, len(list_filter({f}, lambda x: x = term)) AS tf_{f}' for f in _FIELDS_SQL)} FROM t, (SELECT unnest(['apache', 'license', 'nowhere', 'licensed']) AS term)),
  q AS (SELECT * FROM p WHERE tf_title + tf_meta + tf_summary + tf_body > 0),
  d AS (SELECT term, count(*) AS df FROM q GROUP BY term),
  c AS (SELECT id, term, {_LADDER_PART} AS part FROM q JOIN d USING (term), s WHERE id IN (SELECT id FROM notes WHERE {LIVE_SQL})),
  k AS (SELECT coalesce(list(term), []) AS known, arg_max(term, df) AS most FROM d WHERE term <> 'licensed'),
  kk AS (SELECT CASE WHEN len(known) = 2 THEN known WHEN len(known) = 3 THEN list_filter(known, lambda w: w <> most) ELSE [] END AS narrowed FROM k),
  g AS (SELECT id, round(coalesce(sum(part) FILTER (term <> 'licensed'), 0), 9) AS s0, count(*) FILTER (term <> 'licensed') AS h0,
               round(coalesce(sum(part) FILTER (list_contains(narrowed, term)), 0), 9) AS s2, count(*) FILTER (list_contains(narrowed, term)) AS h2, max(len(narrowed)) AS n2,
               round(coalesce(sum(part) FILTER (term = 'licensed'), 0), 9) AS s4, count(*) FILTER (term = 'licensed') AS h4 FROM c, kk GROUP BY id),
  live AS (SELECT * FROM notes WHERE {LIVE_SQL}),
  w AS (SELECT id, list_filter(['apache', 'license', 'nowhere'], lambda x: len(list_filter({TOKENS_SQL("concat_ws(' ', title, summary)")}, lambda y: starts_with(y, x))) > 0) AS heads,
               list_filter(['apache', 'license', 'nowhere'], lambda x: contains(lower(concat_ws(chr(10), title, summary)), x)) AS likes FROM live),
  l AS (SELECT 0 AS rung, id, s0 AS score FROM g WHERE h0 = 3 UNION ALL SELECT 1, id, s0 FROM g WHERE h0 = 3 UNION ALL SELECT 2, id, s2 FROM g WHERE n2 > 0 AND h2 = n2
        UNION ALL SELECT 3, id, s0 FROM g WHERE h0 > 0 UNION ALL SELECT 4, id, s4 FROM g WHERE h4 > 0
        UNION ALL SELECT 5, id, len(heads) FROM w WHERE len(heads) > 0 UNION ALL SELECT 6, id, len(likes) FROM w WHERE len(likes) > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY score DESC, id) AS rank FROM l QUALIFY rank <= 50)
  SELECT id, rung, round(1.0::DOUBLE / (10 + rank), 9) AS rrf FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY rung) = 1"""

SQL = {
    "bm25_top10": f"WITH {NOTES_SQL}, {_bm25_sql(TERMS)} SELECT * FROM scored ORDER BY score DESC, id LIMIT 10",
    "bm25f_fields": _BM25F_SQL,
    "rrf_two_lists": f"""WITH {NOTES_SQL}, {_bm25_sql(TERMS, 'a')}, {_bm25_sql(MORE, 'b')},
        l AS (SELECT id, 1.0 AS w, row_number() OVER (ORDER BY score DESC, id) AS r FROM a UNION ALL SELECT id, 0.5, row_number() OVER (ORDER BY score DESC, id) FROM b)
        SELECT id, round(sum(w::DOUBLE / (10 + r)), 9) AS rrf FROM l WHERE r <= 50 GROUP BY id""",
    "coverage_gate": f"""WITH {NOTES_SQL},
        t AS (SELECT id, list_distinct(list_intersect({TOKENS_SQL("title || ' ' || array_to_string(tags, ' ') || ' ' || scope || ' ' || summary || ' ' || body")}, ['license','version','apache','gnu','unseenword'])) AS has FROM notes),
        r AS (SELECT count(DISTINCT h) AS real FROM (SELECT unnest(has) AS h FROM t))
        SELECT id, len(has) AS covered FROM t, r WHERE len(has) > 0 AND real >= 3 AND len(has) >= greatest(1, (real + 1) // 2)""",
    "phrase_docs": f"""WITH {NOTES_SQL}, b AS (SELECT item_id, split_part(text, '.', 1) AS phrase FROM benchmark)
        SELECT item_id, id FROM notes, b WHERE length(phrase) >= 20 AND contains(title || chr(10) || summary || chr(10) || body, phrase)""",
    "tag_scope_rank": f"WITH {NOTES_SQL} SELECT id, created FROM notes WHERE scope IN ('de','src3') OR list_has_any(tags, ['de','src3']) ORDER BY created DESC, id LIMIT 50",
    "like_head_rank": f"""WITH {NOTES_SQL} SELECT id, created, CASE WHEN contains(lower(title), 'ver') THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS score
        FROM notes WHERE contains(lower(title), 'ver') OR contains(lower(summary), 'ver') ORDER BY score DESC, created DESC, id LIMIT 50""",
    "filter_list": f"""WITH {NOTES_SQL} SELECT id, type, scope, created FROM notes WHERE {LIVE_SQL} AND type IN ('decision','fact','howto')
        AND list_contains(tags, 'en') AND created >= DATE '2024-03-01' AND created < DATE '2024-12-01'""",
    "final_score_decay": f"""WITH {NOTES_SQL}, {_bm25_sql(TERMS)},
        r AS (SELECT id, round(1.0::DOUBLE / (10 + row_number() OVER (ORDER BY score DESC, id)), 9) AS rrf FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 50),
        x AS (SELECT r.id, rrf,
          least(1.0::DOUBLE + CASE WHEN pinned AND {LIVE_SQL} THEN 0.5 ELSE 0.0 END + CASE WHEN type IN ('issue','decision') THEN 0.3 ELSE 0.0 END
            + CASE WHEN scope = 'src3' THEN 0.2 ELSE 0.0 END + 0.1::DOUBLE * (importance - 3), 1.5::DOUBLE) AS bonus,
          0.3::DOUBLE + 0.7::DOUBLE * CASE WHEN {_HALF} IS NULL THEN 1.0 ELSE pow(0.5::DOUBLE, greatest(DATE '2025-02-10' - created, 0)::DOUBLE / {_HALF}::DOUBLE) END AS decay,
          CASE WHEN {LIVE_SQL} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS trust FROM r JOIN notes USING (id))
        SELECT id, rrf, bonus, round(decay, 9) AS decay, trust, round(rrf * bonus * decay * trust, 9) AS score FROM x""",
    "facet_scope": f"WITH {NOTES_SQL} SELECT scope AS value, count(*) AS n FROM notes GROUP BY 1",
    "facet_tag": f"WITH {NOTES_SQL} SELECT value, count(*) AS n FROM (SELECT unnest(tags) AS value FROM notes WHERE {LIVE_SQL}) GROUP BY 1",
    "vocab_prefix": f"""WITH {NOTES_SQL} SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct(list_filter({TOKENS_SQL('body')}, lambda t: starts_with(t, 'ver')))) AS term FROM notes)
        GROUP BY term ORDER BY docs DESC, term LIMIT 20""",
    "zero_hit_explain": f"""WITH {NOTES_SQL}, t AS (SELECT {TOKENS_SQL('body')} AS toks FROM notes)
        SELECT term, least(count(*) FILTER (list_contains(toks, term)), 500) AS docs, count(*) FILTER (list_contains(toks, term)) = 0 AS missing
        FROM t, (SELECT unnest(['license','the','qqqq','apache','unseenword']) AS term) GROUP BY term""",
    "search_index": f"""WITH {NOTES_SQL}, t AS ({' UNION ALL '.join(f"SELECT id, '{f}' AS field, unnest({TOKENS_SQL(x)}) AS term FROM notes" for f, x in _FIELDS_SQL.items())})
        SELECT term, id, {', '.join(f"count(*) FILTER (field = '{f}')::INT AS {f}" for f in _FIELDS_SQL)} FROM t GROUP BY term, id""",
    "search_ladder": _LADDER_SQL,
    "context_block": f"""WITH {NOTES_SQL},
        p AS (SELECT id, created, CASE WHEN pinned THEN 1 WHEN type = 'decision' THEN 2 WHEN type = 'todo' THEN 3 WHEN type = 'fact' THEN 4 WHEN type IN ('issue', 'caution') THEN 5 END AS section,
              regexp_replace(translate(trim(regexp_replace(regexp_replace(summary, '[\\p{{Cf}}]', '', 'g'), '[\\s\\p{{Cc}}]+', ' ', 'g'), ' '), '<>`[]{{}}', '‹›''()()'), '^[ \\t]*[#>*+-]+[ \\t]*', '') AS plain
              FROM notes WHERE superseded_by IS NULL AND invalid_at IS NULL AND scope IN ('src0', 'all')),
        q AS (SELECT *, CASE WHEN length(plain) > 100 THEN left(plain, 99) || '…' ELSE plain END AS line, row_number() OVER (PARTITION BY section ORDER BY created DESC, id) AS place FROM p WHERE section IS NOT NULL),
        r AS (SELECT *, sum({_EST.format(x='line')}) OVER (ORDER BY section, place)::BIGINT AS used FROM q WHERE place <= 5)
        SELECT section, place, id, line, used FROM r WHERE used <= 300""",
    "token_budget": f"""SELECT doc_id AS id, {_EST.format(x='text')} AS tokens, CASE WHEN {_EST.format(x='text')} <= 200 THEN length(text) ELSE
        (SELECT max(i) FROM range(0, 700) r(i) WHERE {_EST.format(x='left(text, i::INT)')} <= 200) END::INT AS prefix FROM documents""",
}
