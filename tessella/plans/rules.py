"""Registered data-quality queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.operators import rules as R
from tessella.plans.common import AS_OF, LIVE_SQL, NOTES_SQL, notes, table

FIELD = ["F02", "F04", "F05", "F06", "F08", "F09-2", "F20"]
BODY = ["B01", "B02", "B03", "B04", "B09", "B11", "M02"]


def edges(spark, sf_dir):
    """Derived edges: every fifth note cites the seventh before it, every eleventh links to the third after it."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    kinds = F.array(
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit("source").alias("kind"), (F.col("doc_id") - 7).alias("dst"))), F.when(F.col("doc_id") % 11 == 0, F.struct(F.lit("link").alias("kind"), (F.col("doc_id") + 3).alias("dst")))
    )
    return d.select(F.col("doc_id").alias("src"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select("src", "x.dst", "x.kind")


def hits(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("cmd"))


def rule_field_findings(spark, sf_dir):
    return R.row_findings(notes(spark, sf_dir), AS_OF, FIELD)


def rule_body_findings(spark, sf_dir):
    return R.row_findings(notes(spark, sf_dir), AS_OF, BODY)


def rule_security_findings(spark, sf_dir):
    return R.row_findings(notes(spark, sf_dir), AS_OF, ["E01", "E03", "E05"])


def rule_all_findings(spark, sf_dir):
    """Every single-row rule that the columns allow, in one pass, counted."""
    n = notes(spark, sf_dir).withColumn("state", F.lit(None).cast("string"))
    return R.row_findings(n, AS_OF).groupBy("rule", "level").agg(F.count("*").alias("notes"))


def tag_broad(spark, sf_dir):
    return R.broad_tags(notes(spark, sf_dir))


def scope_skew(spark, sf_dir):
    return R.scope_skew(notes(spark, sf_dir), share=0.04)


def stale_age(spark, sf_dir):
    return R.stale_age(notes(spark, sf_dir), AS_OF)


def cold_notes(spark, sf_dir):
    return R.cold(notes(spark, sf_dir), hits(spark, sf_dir), AS_OF)


def orphan_notes(spark, sf_dir):
    return R.orphans(notes(spark, sf_dir), hits(spark, sf_dir), edges(spark, sf_dir))


def dead_links(spark, sf_dir):
    return R.dead_links(notes(spark, sf_dir), edges(spark, sf_dir))


def stale_basis(spark, sf_dir):
    return R.stale_basis(notes(spark, sf_dir), edges(spark, sf_dir), AS_OF)


def cited_not_superseded(spark, sf_dir):
    return R.cited_not_superseded(notes(spark, sf_dir), edges(spark, sf_dir), AS_OF, ["ing", "version"])


def review_queues(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("state", F.lit(None).cast("string"))
    return R.review_queues(R.row_findings(n, AS_OF, ["C18", "E01", "E03", "E05"]))


def health(spark, sf_dir):
    return R.health(notes(spark, sf_dir), AS_OF)


def redact_pii(spark, sf_dir):
    text, n = R.redact(F.col("text"), [R.EMAIL, r"AKIA[0-9A-Z]{16}", r"\b\d{3}-\d{3}-\d{4}\b"], "[gone]")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), F.md5(text).alias("text_md5"))


def secret_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(R.any_of(F.col("text"), R.SECRETS)).select("doc_id")


def injection_flag(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.any_of(F.col("text"), R.INJECTIONS).alias("flag"))


def neutralize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.translate("html", "<>`[]{}", "‹›'()()")).alias("html_md5"), F.length(X.one_line(F.col("html"))).alias("n"))


def facts(spark, sf_dir):
    f = X.facts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(f["numbers"]).alias("numbers"), F.size(f["names"]).alias("names"), F.array_join(F.slice(f["numbers"], 1, 5), " ").alias("some"))


def number_norm(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\d[\d,]*\d"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("word")).select("doc_id", "word", X.number_plain(F.col("word")).alias("plain"))


def camel_split(spark, sf_dir):
    found = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("[A-Za-z]*[a-z][A-Z][A-Za-z]*"), F.lit(0))))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("word")).select("page_id", "word", F.array_join(X.camel_parts(F.col("word")), " ").alias("parts"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_field_findings, rule_body_findings, rule_security_findings, rule_all_findings, tag_broad, scope_skew, stale_age, cold_notes, orphan_notes, dead_links, stale_basis,
        cited_not_superseded, review_queues, health, redact_pii, secret_hits, injection_flag, neutralize, facts, number_norm, camel_split,
    )
}


def _any_sql(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, $re${p}$re$)" for p in patterns) + ")"


def _rules_sql(rules: dict[str, tuple[str, str]]) -> str:
    return f"WITH {NOTES_SQL} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{level}' AS level, id FROM notes WHERE {c}" for r, (level, c) in rules.items())


EDGES_SQL = "edges AS (SELECT doc_id AS src, doc_id - 7 AS dst, 'source' AS kind FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, doc_id + 3, 'link' FROM documents WHERE doc_id % 11 = 0)"
_LINES = "string_split(body, chr(10))"
_SUBST = f"list_filter({_LINES}, lambda x: trim(x, ' ') <> '' AND NOT starts_with(trim(x, ' '), '#'))"
_FIRST = f"trim(coalesce(({_SUBST})[1], ''), ' ')"
def _secret_sql(x: str) -> str:
    """E01 by its own words: the plain shapes, and for passwords and long runs the values that look like secrets."""
    plain = [p for p in R.SECRETS if "(?=" not in p]
    value = "regexp_extract_all({x}, '(?i)\\b(?:password|passwd|pw|token|secret|api[_-]?key)\\b\\s*[:=]\\s*(\\S{{4,}})', 1)".format(x=x)
    looks = "regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9!@#$%^&*+~]') AND NOT regexp_matches(v, '^[0-9.,]+[A-Za-z%]*[^\\sA-Za-z0-9]*$')"
    blobs = f"list_filter(regexp_extract_all({x}, '[A-Za-z0-9+]{{40,}}'), lambda v: regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]'))"
    return f"({_any_sql(x, plain)} OR len(list_filter({value}, lambda v: {looks})) > 0 OR len({blobs}) > 0)"


_WHOLE = "concat_ws(chr(10), title, summary, body)"
_HOME = """regexp_matches({x}, '(?m)(^|[\\s(\\[|>"''`])([A-Za-z]:\\\\[Uu][Ss][Ee][Rr][Ss]\\\\[^\\\\\\s|]+|/home/[^/\\s|]+|/Users/[^/\\s|]+)')"""
_SECURITY = {"E01": ("reject", _secret_sql(_WHOLE)), "E03": ("warn", _HOME.format(x=_WHOLE)), "E05": ("warn", _any_sql("body", R.INJECTIONS))}
_DEAD = f"NOT {LIVE_SQL}"

SQL = {
    "rule_field_findings": _rules_sql({
        "F02": ("reject", "id IS NULL OR trim(type) = '' OR trim(summary) = '' OR summary IS NULL OR trim(scope) = '' OR scope IS NULL OR len(tags) = 0"),
        "F05": ("reject", "NOT length(summary) BETWEEN 30 AND 120"),
        "F06": ("reject", "NOT length(title) BETWEEN 6 AND 40 OR starts_with(title, left(summary, 20))"),
        "F08": ("reject", "NOT len(tags) BETWEEN 2 AND 5"),
        "F09-2": ("reject", "len(list_filter(tags, lambda t: NOT regexp_matches(t, '^[a-z0-9][a-z0-9-]{0,29}$'))) > 0"),
        "F20": ("reject", "created > DATE '2025-02-10'"),
    }),
    "rule_body_findings": _rules_sql({
        "B01": ("reject", f"len({_SUBST}) < 3"), "B02": ("warn", f"len({_LINES}) BETWEEN 121 AND 300"),
        "B03": ("warn", f"(length({_FIRST}) < 20 AND NOT (ends_with({_FIRST}, '.') AND length({_FIRST}) >= 10)) OR " + " OR ".join(f"ends_with({_FIRST}, '{t}')" for t in R.QUESTION_TAILS)),
        "B04": ("warn", f"len(list_filter({_LINES}, lambda x: starts_with(trim(x, ' '), '##'))) > 8"), "B09": ("reject", _any_sql("body", [*R.RELATIVE_DATES, R.RECENT])),
        "B11": ("reject", f"len({_LINES}) > 300"), "M02": ("warn", _any_sql("summary", R.BUNDLES)),
    }),
    "rule_security_findings": _rules_sql(_SECURITY),
    "tag_broad": f"WITH {NOTES_SQL}, t AS (SELECT id, unnest(list_distinct(tags)) AS tag FROM notes), n AS (SELECT count(*) AS n FROM notes) SELECT tag, count(*) AS notes, n FROM t, n WHERE n >= 20 GROUP BY tag, n HAVING count(*) > 0.2 * n",
    "scope_skew": f"WITH {NOTES_SQL}, n AS (SELECT count(*) AS n FROM notes) SELECT scope, count(*) AS notes, n FROM notes, n WHERE n >= 20 GROUP BY scope, n HAVING count(*) > 0.04::DOUBLE * n",
    "stale_age": f"""WITH {NOTES_SQL} SELECT id, type, DATE '2025-02-10' - created AS age FROM notes WHERE {LIVE_SQL}
        AND DATE '2025-02-10' - created > CASE type WHEN 'history' THEN 180 WHEN 'fact' THEN 360 WHEN 'decision' THEN 1440 WHEN 'howto' THEN 1440 END""",
    "cold_notes": f"""WITH {NOTES_SQL}, h AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
        SELECT id, last FROM notes LEFT JOIN h ON id = user_id WHERE DATE '2025-02-10' - created > 180 AND (last IS NULL OR DATE '2025-02-10' - last::DATE > 180)""",
    "orphan_notes": f"""WITH {NOTES_SQL}, {EDGES_SQL} SELECT id FROM notes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges UNION SELECT user_id FROM events)""",
    "dead_links": f"WITH {EDGES_SQL} SELECT src, dst, kind FROM edges WHERE dst NOT IN (SELECT doc_id FROM documents)",
    "stale_basis": f"""WITH {NOTES_SQL}, {EDGES_SQL} SELECT DISTINCT src, dst, kind FROM edges JOIN (SELECT id, superseded_by FROM notes WHERE {_DEAD}) d ON dst = d.id
        WHERE (d.superseded_by IS NULL OR d.superseded_by <> src) AND src IN (SELECT id FROM notes WHERE {LIVE_SQL})""",
    "cited_not_superseded": f"""WITH {NOTES_SQL}, {EDGES_SQL} SELECT DISTINCT src, dst FROM edges JOIN notes n ON src = n.id JOIN (SELECT * FROM notes WHERE {LIVE_SQL}) o ON dst = o.id
        WHERE regexp_matches(n.body, 'ing|version') AND n.created > o.created AND n.scope = o.scope""",
    "review_queues": f"""WITH {NOTES_SQL}, f AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, id FROM notes WHERE {c}" for r, (_, c) in (_SECURITY | {'C18': ('', f'{_DEAD} AND NOT pinned')}).items())}),
        k AS (SELECT CASE WHEN rule = 'C18' THEN 'retired' ELSE 'security' END AS kind, rule, id FROM f)
        SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY rule, id) AS place, rule, id FROM k QUALIFY place <= 20""",
    "health": f"""WITH {NOTES_SQL} SELECT count(*) AS notes, round(avg({LIVE_SQL}::INT), 9) AS live, round(avg(pinned::INT), 9) AS pinned, round(avg((length(summary) BETWEEN 30 AND 120)::INT), 9) AS summary_ok,
        round(avg((len({_LINES}) <= 120)::INT), 9) AS body_ok, round(avg((len(tags) >= 2)::INT), 9) AS tags_ok FROM notes""",
    "redact_pii": r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[gone]', 'g') AS t1 FROM documents),
        b AS (SELECT *, regexp_replace(t1, 'AKIA[0-9A-Z]{16}', '[gone]', 'g') AS t2 FROM a)
        SELECT doc_id, (len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) + len(regexp_extract_all(t1, 'AKIA[0-9A-Z]{16}')) + len(regexp_extract_all(t2, '\b\d{3}-\d{3}-\d{4}\b')))::BIGINT AS n,
               md5(regexp_replace(t2, '\b\d{3}-\d{3}-\d{4}\b', '[gone]', 'g')) AS text_md5 FROM b""",
    "secret_hits": f"SELECT doc_id FROM documents WHERE {_secret_sql('text')}",
    "injection_flag": f"SELECT conv_id, turn, {_any_sql('text', R.INJECTIONS)} AS flag FROM conversations",
    "neutralize": r"""SELECT page_id, md5(translate(html, '<>`[]{}', '‹›''()()')) AS html_md5, length(trim(regexp_replace(regexp_replace(html, '[\p{Cf}]', '', 'g'), '[\s\p{Cc}]+', ' ', 'g'), ' ')) AS n FROM pages""",
    "facts": r"""WITH f AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '\d[\d.]*'))) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_./-]{2,}')) AS b FROM documents)
        SELECT doc_id, len(a) AS numbers, len(b) AS names, array_to_string(a[1:5], ' ') AS some FROM f""",
    "number_norm": r"""SELECT doc_id, word, CASE WHEN regexp_matches(word, '^\d{1,3}(,\d{3})+$') THEN replace(word, ',', '') ELSE word END AS plain
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d[\d,]*\d')) AS word FROM documents)""",
    "camel_split": r"""SELECT page_id, word, array_to_string(list_filter(string_split(lower(regexp_replace(word, '(\p{Lu})', chr(1) || '\1', 'g')), chr(1)), lambda p: p <> ''), ' ') AS parts
        FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '[A-Za-z]*[a-z][A-Z][A-Za-z]*'))) AS word FROM pages)""",
}
