"""Ranked retrieval: query parsing, matching, BM25F, fusion of ranked lists, final scores, facets, explanations."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.operators.index import FIELDS, Index
from tessella.schema import type_spec

K1, B, SOFTENER, DEPTH = 1.2, 0.4, 10.0, 50
#: Trust in each rung of the ladder, weights of its lists.
TRUST = [1.0, 1.0, 0.85, 0.85, 0.7, 0.6, 0.5]
LIST_WEIGHT = {"word": 1.0, "stem": 0.8, "tag": 0.6, "like": 0.5, "single": 0.4, "norm": 1.5, "synonym": 0.5, "keys": 0.6, "vector": 1.5, "rerank": 1.0}


@dataclass
class Query:
    """What a query text asks for."""

    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    stop: list[str] = field(default_factory=list)
    narrow: P.Narrow = field(default_factory=P.Narrow)

    def live(self) -> list[str]:
        """Terms that are no stop words; all of them if all are."""
        return [t for t in self.terms if t not in self.stop] or self.terms

    def filter_only(self) -> bool:
        return not self.terms and not self.phrases


def time_span(words: list[str], as_of: str) -> tuple[int, str, str] | None:
    """(words used, since, until) of a time expression at the beginning of words."""
    now = date.fromisoformat(as_of)
    monday, first = now - timedelta(days=now.weekday()), now.replace(day=1)
    before = (first - timedelta(days=1)).replace(day=1)
    after = (first + timedelta(days=32)).replace(day=1)
    spans = {
        ("today",): (now, now + timedelta(days=1)), ("yesterday",): (now - timedelta(days=1), now), ("this", "week"): (monday, monday + timedelta(days=7)),
        ("last", "week"): (monday - timedelta(days=7), monday), ("this", "month"): (first, after), ("last", "month"): (before, first),
    }
    for key, (a, b) in spans.items():
        if tuple(w.lower() for w in words[: len(key)]) == key:
            return len(key), a.isoformat(), b.isoformat()
    if words and (m := re.fullmatch(r"(\d{4})-(\d{2})", words[0])) and 1 <= int(m[2]) <= 12:
        a = date(int(m[1]), int(m[2]), 1)
        return 1, a.isoformat(), (a + timedelta(days=32)).replace(day=1).isoformat()
    if words and (m := re.fullmatch(r"(\d+)d", words[0])):
        return 1, (now - timedelta(days=int(m[1]))).isoformat(), (now + timedelta(days=1)).isoformat()
    return None


def parse_query(text: str, as_of: str, stopwords: set[str] = frozenset(), most: int = 8) -> Query:
    """Quoted phrases, #tags, scope:x and time words apart; at most `most` distinct terms."""
    q, tags, scope, since, until = Query(), [], None, None, None
    q.phrases = [" ".join(p.split()) for p in re.findall(r'"([^"]+)"', text) if p.strip()]
    rest = re.sub(r'"[^"]*"', " ", text).split()
    at = 0
    while at < len(rest):
        if span := time_span(rest[at:], as_of):
            used, since, until = span
            at += used
            continue
        w = rest[at]
        at += 1
        if w.startswith("#") and len(w) > 1:
            tags.append(w[1:].lower())
        elif w.startswith("scope:") and len(w) > 6:
            scope = w[6:]
        else:
            q.terms += [t for t in re.split(r"[\W_]+", w.lower()) if t and t not in q.terms]
    q.terms = q.terms[:most]
    q.stop = [t for t in q.terms if t in stopwords]
    q.narrow = P.Narrow(tags=tuple(tags), scope=scope, since=since, until=until)
    return q


def contribution(index: Index, dfs: dict[str, int], weights: dict[str, float]) -> Column:
    """What a posting adds to its note's BM25F score: idf ln((N-df+.5)/(df+.5)), 1e-6 at least, times each field's share."""
    n = index.statistics["n"]
    idf = F.element_at(F.create_map(*[F.lit(x) for t, df in dfs.items() for x in (t, max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6))]), F.col("term")) if dfs else F.lit(0.0)
    total = F.lit(0.0)
    for f, w in weights.items():
        tf, norm = F.col(f"tf_{f}"), 1 - B + B * F.col(f"len_{f}") / F.lit(float(index.statistics[f] or 1.0))
        total = total + F.when(tf > 0, w * idf * tf * (K1 + 1) / (tf + K1 * norm)).otherwise(0.0)
    return total


def bm25(index: Index, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score, hits) of notes that have a term in one of the weighted fields; only the terms' postings are read."""
    weights = weights or FIELDS
    only = next(iter(weights)) if len(weights) == 1 else None
    dfs = index.frequencies(terms, only)
    rows = index.matches([*dfs]).where(" OR ".join(f"tf_{f} > 0" for f in weights))
    return rows.groupBy("id").agg(F.round(F.sum(contribution(index, dfs, weights)), 9).alias("score"), F.count("*").alias("hits"))


def batch_bm25(index: Index, queries: DataFrame, weights: dict[str, float] | None = None, field: str | None = None, depth: int = DEPTH) -> DataFrame:
    """(case, id, score, rank) of queries(case, term): the first `depth` notes of each; terms meet postings in one join.

    The join's sides are shuffled by term unless the queries are few; a case has as many rows as postings of its terms.
    """
    weights = weights or FIELDS
    n = float(index.statistics["n"])
    words = index._vocabulary.select("term", F.col(f"docs_{field}" if field else "docs").alias("df")).where("df > 0")
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    asked = queries.distinct().join(words, "term").withColumn("idf", idf)
    total = F.lit(0.0)
    for f, w in weights.items():
        tf, norm = F.col(f"tf_{f}"), 1 - B + B * F.col(f"len_{f}") / F.lit(float(index.statistics[f] or 1.0))
        total = total + F.when(tf > 0, w * F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)).otherwise(0.0)
    rows = asked.join(index._postings.where(" OR ".join(f"tf_{f} > 0" for f in weights)), "term")
    scores = rows.groupBy("case", "id").agg(F.round(F.sum(total), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= depth)


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    return scored.orderBy(*(order or (F.desc("score"), F.asc("id")))).limit(k)


def ranked(scored: DataFrame, name: str, weight: float, depth: int = DEPTH) -> DataFrame:
    """A list's first rows as (list, weight, id, rank); only the top `depth` rows reach the window."""
    best = top(scored, depth)
    return best.select(F.lit(name).alias("list"), F.lit(weight).alias("weight"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def fuse(lists: list[DataFrame], softener: float = SOFTENER, boosts: list[DataFrame] = ()) -> DataFrame:
    """(id, rrf): reciprocal rank fusion; boost lists only lift ids that the other lists admit."""
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    for b in boosts:
        every = every.unionByName(b.join(every.select("id").distinct(), "id", "left_semi"))
    return every.groupBy("id").agg(F.round(F.sum(F.col("weight") / (softener + F.col("rank"))), 9).alias("rrf"))


def phrase_match(notes: DataFrame, phrase: Column | str) -> Column:
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.concat_ws("\n", "title", "summary", "body"), p)


def phrase_documents(index: Index, notes: DataFrame, asked: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, id) of notes that contain a phrase of asked(key, phrase) literally.

    A note can only contain a phrase whose inner words it has: each phrase looks up the postings of its rarest inner word,
    and only those notes' texts are compared. The first and the last word may be parts of longer ones and do not count. A
    phrase without an inner word that the store has is in no note, unless it has none at all: such are looked for by text.
    """
    inner = F.expr("slice(words, 2, greatest(size(words) - 2, 0))")
    rows = asked.select(key, "phrase", X.index_tokens(F.col("phrase")).alias("words")).select(key, "phrase", F.array_distinct(inner).alias("words"))
    words = rows.where("size(words) > 0").select(key, "phrase", F.explode("words").alias("term"))
    known = words.join(index._vocabulary.select("term", "docs"), "term", "left").groupBy(key, "phrase").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "term")).alias("rare"))
    maybe = known.where("rare.docs > 0").select(key, "phrase", F.col("rare.term").alias("term")).join(index._postings.select("term", "id"), "term").select(key, "phrase", "id")
    found = notes.join(maybe.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).where(phrase_match(notes, F.col("phrase"))).select(key, "id")
    short = rows.where("size(words) = 0").select(key, "phrase")
    return found.unionByName(notes.join(short, phrase_match(notes, F.col("phrase"))).select(key, "id"))


def coverage(index: Index, terms: list[str]) -> DataFrame:
    """(id, covered) of notes that have enough of the terms: a majority of terms must occur at all, and half of those, rounded up, in the note."""
    real = len(index.frequencies(terms))
    rows = index.matches(terms).groupBy("id").agg(F.count("*").cast("int").alias("covered"))
    return rows.where(F.lit(real >= P.majority_of(len(terms))) & (F.col("covered") >= P.need_of(real)))


def tag_scope_rank(notes: DataFrame, words: list[str]) -> DataFrame:
    hit = F.col("scope").isin(*words)
    for w in words:
        hit = hit | F.array_contains("tags", w)
    return notes.where(hit).select("id", "created")


def like_head(notes: DataFrame, word: str) -> DataFrame:
    """Title before summary, then the newest."""
    score = F.when(F.contains(F.lower("title"), F.lit(word)), 1.0).when(F.contains(F.lower("summary"), F.lit(word)), 0.7)
    return notes.select("id", "created", score.alias("score")).where("score is not null")


def final_score(rows: DataFrame, as_of: str, rung: Column, boost_scope: str | None = None, cap: float = 1.5) -> DataFrame:
    """Adds bonus, decay, trust and score to rows of notes with rrf; hit_count, severity, phrase, linked, state and obs_stale count if there."""
    has = lambda c: c in rows.columns
    spec = F.broadcast(type_spec(rows.sparkSession).select(F.col("type").alias("_type"), "half_life", F.col("bonus").alias("_bonus"), F.col("todo").alias("_todo")))
    x = rows.join(spec, F.col("type") == F.col("_type"), "left")
    dead = P.is_dead(as_of)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    bonus = 1.0 + flag(F.col("pinned") & ~dead, 0.5) + flag(F.coalesce("_bonus", F.lit(False)), 0.3)
    bonus = bonus + (flag(F.col("severity") == "high", 0.2) if has("severity") else 0) + (flag(F.col("scope") == boost_scope, 0.2) if boost_scope else 0)
    bonus = bonus + (flag(F.col("linked"), 0.1) if has("linked") else 0) + (flag(F.col("phrase"), 0.3) if has("phrase") else 0)
    bonus = bonus + (0.2 * F.ln(1 + F.col("hit_count")) if has("hit_count") else 0) + 0.1 * (F.coalesce(F.nullif("importance", F.lit(0)), F.lit(3)) - 3)
    age = F.greatest(F.datediff(P.day(as_of), "created"), F.lit(0))
    half = F.when(F.col("_todo") & (F.col("todo_status") == "done"), 90.0).otherwise(F.col("half_life")) if has("todo_status") else F.col("half_life")
    decay = 0.3 + 0.7 * F.when(F.coalesce(half, F.lit(0.0)) > 0, F.pow(F.lit(0.5), age / half)).otherwise(1.0)
    trust = F.element_at(F.array(*map(F.lit, TRUST)), rung + 1) * F.when(dead, 0.5).otherwise(1.0)
    trust = trust * (F.when(F.coalesce("obs_stale", F.lit("")) != "", 0.5).otherwise(1.0) if has("obs_stale") else 1.0) * (F.when(F.col("state") == "cold", 0.7).otherwise(1.0) if has("state") else 1.0)
    x = x.withColumn("bonus", F.least(bonus, F.lit(cap))).withColumn("decay", decay).withColumn("trust", trust).drop("_type", "half_life", "_bonus", "_todo")
    return x.withColumn("score", F.round(F.col("rrf") * F.col("bonus") * F.col("decay") * F.col("trust"), 9))


def _begins(prefix: str):
    return lambda w: F.startswith(w, F.lit(prefix))


def narrowed_terms(terms: list[str], dfs: dict[str, int]) -> list[str]:
    """Rung 2: the terms that the store has, if they are a majority; if all are there, and three or more, all but the most frequent."""
    known = [t for t in terms if t in dfs]
    if len(terms) < 2 or not known:
        return []
    if len(known) < len(terms):
        return known if len(known) >= P.majority_of(len(terms)) else []
    if len(terms) < 3:
        return []
    most = max(terms, key=lambda t: (dfs[t], -terms.index(t)))
    return [t for t in terms if t != most]


def rungs(index: Index, pool: DataFrame, query: Query, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, rung, rrf) over the ladder: all words, without stop words, with some words dropped, any word, synonyms, prefixes, substrings.

    The postings of all words are read and scored in one pass, whatever the rung; an id counts in the first rung that
    admits it. Only ids of the pool, the notes that the query's filters leave, are ranked.
    """
    terms = query.live()
    swapped = [s for t in terms for s in (synonyms or {}).get(t, [])[:3]]
    every = [*dict.fromkeys([*query.terms, *swapped])]
    dfs = index.frequencies(every)
    sets = [query.terms, terms, narrowed_terms(terms, dfs), query.terms, swapped]
    need = [len(query.terms), len(terms), len(sets[2]), 1, 1]
    part = contribution(index, dfs, FIELDS)
    sums = [x for r, s in enumerate(sets) for x in (F.round(F.sum(F.when(F.col("term").isin(*s), part).otherwise(0.0)), 9).alias(f"s{r}"), F.count(F.when(F.col("term").isin(*s), 1)).alias(f"h{r}"))]
    scores = index.matches([*dfs]).groupBy("id").agg(*sums).join(pool.select("id"), "id", "left_semi")
    steps = [scores.where(F.col(f"h{r}") >= max(1, need[r])).select("id", F.col(f"s{r}").alias("score")) if sets[r] else scores.where(F.lit(False)).select("id", F.col("s0").alias("score")) for r in range(5)]
    heads = [F.exists(X.words(F.concat_ws(" ", "title", "summary")), _begins(t)).cast("int") for t in terms]
    steps.append(pool.select("id", sum(heads[1:], heads[0]).cast("double").alias("score")).where("score > 0"))
    likes = [F.contains(F.lower(F.concat_ws("\n", "title", "summary")), F.lit(t)).cast("int") for t in terms]
    steps.append(pool.select("id", sum(likes[1:], likes[0]).cast("double").alias("score")).where("score > 0"))
    lists = [ranked(s.select("id", "score"), f"rung{r}", 1.0).withColumn("rung", F.lit(r)) for r, s in enumerate(steps)]
    merged = lists[0]
    for more in lists[1:]:
        merged = merged.unionByName(more)
    first = Window.partitionBy("id").orderBy("rung")
    return merged.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "rung", F.round(1 / (SOFTENER + F.col("rank")), 9).alias("rrf"))


def search(index: Index, notes: DataFrame, text: str, as_of: str, limit: int = 5, stopwords: set[str] = frozenset(), synonyms: dict | None = None, enough: int | None = None, edges: DataFrame | None = None, options: P.Narrow | None = None) -> DataFrame:
    """Hits of a query: (id, title, rung, rrf, bonus, decay, trust, score), best first; with edges also place and topic of the reranked hits.

    Rungs below the first that gives `enough` hits are left out, as a ladder climbed step by step would leave them. A time
    span that leaves nothing is dropped and the query asked again. Options narrow as well; their dates win.
    """
    query = parse_query(text, as_of, stopwords)
    query.narrow = merged_narrow(query.narrow, options)
    if query.filter_only():
        return notes.where(P.where_of(query.narrow, as_of)).orderBy(F.desc("created"), "id").limit(limit).select("id", "title")
    pool = notes.where(P.where_of(query.narrow, as_of))
    for p in query.phrases:
        pool = pool.where(phrase_match(pool, p))
    hits = rungs(index, pool, query, synonyms)
    by_rung = Window.orderBy("rung").rangeBetween(Window.unboundedPreceding, -1)  # of at most 7 x 50 rows
    hits = hits.withColumn("before", F.count("*").over(by_rung)).where(F.col("before") < (enough or limit)).drop("before")
    if (query.narrow.since or query.narrow.until) and not hits.head(1):
        plain = P.Narrow(**{**vars(query.narrow), "since": None, "until": None})
        return search(index, notes, " ".join(query.terms), as_of, limit, stopwords, synonyms, enough, edges, plain)
    rows = final_score(pool.join(F.broadcast(hits), "id"), as_of, F.col("rung"))  # at most 7 x 50 rows
    if edges is not None:
        from tessella.operators.rerank import rerank

        places = rerank(rows.select(F.lit(0).alias("query"), "id", "title", "tags", "scope", "created", "bonus", "score"), edges)
        rows = rows.drop("score").join(places.select("id", "place", "score", "topic"), "id")
        return rows.orderBy("place").limit(limit).select("id", "title", "rung", "rrf", "bonus", "decay", "trust", "score", "place", "topic")
    return rows.orderBy(F.desc("score"), F.desc("created"), "id").limit(limit).select("id", "title", "rung", "rrf", "bonus", "decay", "trust", "score")


def merged_narrow(inline: P.Narrow, options: P.Narrow | None) -> P.Narrow:
    """Inline filters with those of the options: lists join, single values of the options win."""
    if options is None:
        return inline
    return P.Narrow(
        types=(*inline.types, *options.types), scope=options.scope or inline.scope, tags=tuple(dict.fromkeys((*inline.tags, *options.tags))),
        pinned=options.pinned if options.pinned is not None else inline.pinned, since=options.since or inline.since, until=options.until or inline.until,
        dead=inline.dead or options.dead, more=(*inline.more, *options.more),
    )


def facet(notes: DataFrame, kind: str) -> DataFrame:
    value = F.explode("tags") if kind == "tag" else F.col("scope")
    return notes.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def vocab_prefix(index: Index, prefix: str, limit: int) -> DataFrame:
    """Most used words of bodies that begin so: (term, docs)."""
    return index.beginning(prefix, "body").orderBy(F.desc("docs"), "term").limit(limit)


def explain_empty(index: Index, terms: list[str]) -> DataFrame:
    """(term, docs, missing): how many notes have each query word in their bodies, counted to 500."""
    dfs = index.frequencies(terms, "body")
    return index.spark.createDataFrame([(t, min(dfs.get(t, 0), 500), t not in dfs) for t in terms], "term string, docs bigint, missing boolean")


def near_words(index: Index, term: str, most: int = 5) -> DataFrame:
    """(term, docs, distance): words of the store that are nearest to one that it lacks, by edits, within a third of its length."""
    d = F.levenshtein(F.col("term"), F.lit(term))
    close = index.beginning(term[:1]).withColumn("distance", d).where(F.col("distance") <= max(1, len(term) // 3))
    return close.orderBy("distance", F.desc("docs"), "term").limit(most)


def context_block(notes: DataFrame, as_of: str, scope: str, per_section: int = 5, budget: int = 1000) -> DataFrame:
    """Lines of a budgeted context block: (section, place, id, line), sections in order, no id twice, cut at the token budget."""
    live = notes.where(P.is_hook_live() & F.col("scope").isin(scope, "all"))
    section = F.when(F.col("pinned"), 1).when(F.col("type") == "decision", 2).when(F.col("type") == "todo", 3).when(F.col("type") == "fact", 4).when(F.col("type").isin("issue", "caution"), 5)
    picked = live.select("id", "created", section.alias("section"), X.clip(X.neutralize(X.one_line(F.col("summary"))), 100).alias("line")).where("section is not null")
    places = picked.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("created"), "id"))).where(F.col("place") <= per_section)
    used = F.sum(X.token_estimate(F.col("line"))).over(Window.orderBy("section", "place").rowsBetween(Window.unboundedPreceding, 0))  # of at most 5 sections
    return places.withColumn("used", used).where(F.col("used") <= budget).select("section", "place", "id", "line", "used")
