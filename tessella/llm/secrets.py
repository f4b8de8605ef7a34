"""Secret scans with multipart credential linking, in DataFrame functions only.

Patterns give spans; an interval join within a scope links identifiers, secrets and endpoints. Parts that say little
alone are reported only next to the parts that complete them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import with_row_key, written

#: kind: (pattern, shortest match, shortest group 2 or 0, role); strong kinds first, in the order they are told in.
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 6, "secret"),
    "access": (r"AKIA[A-Z0-9]+", 20, 0, "identifier"),
    "hex": (r"[0-9a-f]+", 24, 0, "secret"),
}
WEAK = {
    "blob": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])", 0, 0, "secret"),
    "identifier": (r"""(?i:(?:\b|(?<=_))(client_?id|access_?key_?id|account(?:_?(?:id|name))?|user(?:name)?|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", 0, 3, "identifier"),
    "endpoint": (r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+""", 0, 0, "endpoint"),
}
KINDS = STRONG | WEAK
#: The same match as the pattern's, or a cheaper test that it may match, for texts that need no closer look.
MAY = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}


def _lengths(text: Column, kind: str) -> Column:
    """Per match: length of the text before it since the match before, of the match, and of its second group."""
    pattern, _, value, _ = KINDS[kind]
    length = lambda a: F.transform(a, lambda x: F.length(x))
    gaps, hits = length(F.split(text, pattern, -1)), length(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    groups = length(F.regexp_extract_all(text, F.lit(pattern), F.lit(2))) if value else hits
    found = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), groups.alias("value"))
    return F.when(F.regexp_like(text, F.lit(MAY.get(kind, pattern))), found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind; base_sha256 is of the strong
    ones, comma-joined. Weak parts outside the strong spans are added where parts of other roles start at most `scope`
    code points away: a blob (secret) needs an identifier, an identifier needs a secret, an endpoint needs both. Whole
    texts are scanned; a null or empty text has no spans and the digest of the empty string. Repeated rows are told
    one by one, nulls in any column do no harm, and an empty table gives no rows.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = with_row_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")))
    found = written(rows.select("_id", F.col("_row.file").alias("f"), F.col("_row.pos").alias("p"), *[_lengths(text, k).alias(k) for k in KINDS]), "found")
    any_hit = F.coalesce(*[F.col(k) for k in KINDS]).isNotNull()
    parts = None
    for n, k in enumerate(KINDS):
        one = found.where(F.col(k).isNotNull()).select("f", "p", F.lit(n).alias("kind"), F.posexplode(k).alias("i", "x"))
        parts = one if parts is None else parts.unionByName(one)
    before = Window.partitionBy("f", "p", "kind").orderBy("i")
    end = F.sum(F.col("x.gap") + F.col("x.hit")).over(before)
    shortest = F.element_at(F.array(*[F.lit(m) for _, m, _, _ in KINDS.values()]), F.col("kind") + 1)
    value = F.element_at(F.array(*[F.lit(v) for _, _, v, _ in KINDS.values()]), F.col("kind") + 1)
    role = F.element_at(F.array(*[F.lit(r) for *_, r in KINDS.values()]), F.col("kind") + 1)
    spans = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("x.hit")).where((F.col("x.hit") >= shortest) & (F.col("x.value") >= value))
    spans = written(spans.select("f", "p", "kind", "start", "end", role.alias("role")), "spans")
    strong, weak = spans.where(F.col("kind") < len(STRONG)), spans.where(F.col("kind") >= len(STRONG))
    cell = F.floor(F.col("start") / scope)
    # a weak part that touches a strong one tells nothing new
    reach = F.explode(F.sequence(cell, F.floor((F.col("end") - 1) / scope)))
    covers = strong.select(F.col("f").alias("f2"), F.col("p").alias("p2"), F.col("start").alias("s2"), F.col("end").alias("e2"), reach.alias("c2"))
    lone = weak.withColumn("c", reach).alias("w")
    touched = lone.join(covers, (F.col("f") == F.col("f2")) & (F.col("p") == F.col("p2")) & (F.col("c") == F.col("c2")) & (F.col("start") < F.col("e2")) & (F.col("end") > F.col("s2"))).select("f", "p", "kind", "start").distinct()
    weak = written(weak.join(touched, ["f", "p", "kind", "start"], "left_anti").withColumn("c", cell), "weak")
    near = strong.select("f", "p", "start", "role").unionByName(weak.select("f", "p", "start", "role")).distinct()
    near = near.select(F.col("f").alias("f2"), F.col("p").alias("p2"), F.col("start").alias("s2"), F.col("role").alias("r2"), F.explode(F.sequence(cell - 1, cell + 1)).alias("c2"))
    pairs = weak.join(near, (F.col("f") == F.col("f2")) & (F.col("p") == F.col("p2")) & (F.col("c") == F.col("c2")) & (F.abs(F.col("start") - F.col("s2")) <= scope) & (F.col("role") != F.col("r2")))
    has = lambda r: F.bool_or(F.col("r2") == r)
    linked = (
        pairs.groupBy("f", "p", "kind", "start", "end", "role").agg(has("identifier").alias("has_id"), has("secret").alias("has_secret"))
        .where(((F.col("role") == "identifier") | F.col("has_id")) & ((F.col("role") == "secret") | F.col("has_secret")))
    )
    told = strong.select("f", "p", "kind", "start", "end").unionByName(linked.select("f", "p", "kind", "start", "end"))
    sums = told.groupBy("f", "p").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all")).withColumnsRenamed({"f": "f2", "p": "p2"})
    names = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    every = F.coalesce("all", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>"))
    hit = found.where(any_hit).select("_id", "f", "p").join(sums, (F.col("f") == F.col("f2")) & (F.col("p") == F.col("p2")), "left").select("_id", every.alias("all"))
    rest = found.where(~any_hit).select("_id", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>").alias("all"))
    count = lambda n: F.size(F.filter("all", lambda s: s["kind"] == n)).cast("long")
    return hit.unionByName(rest).select(
        F.col("_id").alias(id_col), *[count(n).alias(f"n_{k}") for n, k in enumerate(STRONG)],
        F.sha2(joined(F.filter("all", lambda s: s["kind"] < len(STRONG))), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
    )
