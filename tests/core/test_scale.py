"""What used to grow with pairs, with a key's size or with the shuffled texts."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import duplicates as D
from tessella.operators import neighbours as N
from tessella.operators import vectors as V

NOTE = "id long, type string, title string, summary string, body string, tags array<string>, scope string, created date, superseded_by long, invalid_at date, pinned boolean"


def test_candidates_over_crowded_buckets(spark, monkeypatch):
    """Best of buckets, against all pairs; buckets give their best only, and crowded ones nothing, not even `narrow`."""
    monkeypatch.setattr(D, "BUCKET", 25)
    monkeypatch.setattr(D, "PER_NOTE", 5)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefg"), 4))
    known = [" ".join(word() for _ in range(5)) for _ in range(12)]
    rows = []
    for i in range(90):
        lines = [known[k] for k in rng.choice(12, 2, replace=False)] if i % 3 else [" ".join(word() for _ in range(5))]
        rows.append((i, "fact", f"t{i % 7}", word(), "\n".join(lines), ["Big", f"t{i % 6}", f"u{i % 11}"], f"s{i % 2}" if i % 4 else f"r{i % 5}", dt.date(2024, 1, 1), None, None, False))
    notes = spark.createDataFrame(rows, NOTE)
    made = {r.id: r for r in D.marked(notes).collect()}
    keys = {i: [(b, r.fp >> 16 * b & 65535) for b in range(4)] + [(b + 4, r.sfp >> 16 * b & 65535) for b in range(4)] + [(8, s) for s in {*r.sketch}] + [(9, r.scope)] + [(10, t) for t in r.tags] for i, r in made.items()}
    size = {}
    for ks in keys.values():
        for k in ks:
            size[k] = size.get(k, 0) + 1
    good = {i: {k for k in ks if size[k] <= 25} for i, ks in keys.items()}
    assert any(n > 25 for k, n in size.items() if k[0] == 8) and any(n > 25 for k, n in size.items() if k[0] == 9) and size[10, "big"] == 90
    want = set()
    for i in made:
        found = []
        for j in made:
            both = good[i] & good[j]
            if i != j and both:
                shared, far = len({*made[i].tags} & {*made[j].tags}), ((made[i].fp ^ made[j].fp) & 2**64 - 1).bit_count()
                found.append((not any(k[0] == 8 for k in both), -shared, far, j, any(k[0] < 4 or k[0] > 8 for k in both)))
        want |= {(i, j, narrow, not far_off, -less, far, n) for n, (far_off, less, far, j, narrow) in enumerate(sorted(found)[:5], 1)}
    got = D.candidates(notes)
    assert {tuple(r) for r in got.select("left", "right", "narrow", "sketched", "shared", "distance", "place").collect()} == want
    bucket = notes.select("id", F.lit(8).alias("kind"), F.lit(1).cast("long").alias("value"), F.lit(None).cast("string").alias("name"), F.col("id").alias("fp"), "scope", "tags", F.lit(True).alias("asks"))
    none = {k: set() for k in range(D.TAG + 1)}
    best = bucket.coalesce(1).sortWithinPartitions("id").mapInArrow(D._best_of_buckets(none, 5), "left long, sketched boolean, right array<long>, code array<int>, narrow array<boolean>")
    assert best.select(F.sum(F.size("right"))).first()[0] == 90 * 5  # of 90 x 89 pairs


def test_a_text_is_sent_once_a_block(spark):
    """60 copies with 50 candidates each: the scoring's shuffle has each text once, not once a pair."""
    rows = [(i, "fact", "t", f"number {i}", f"line {i} of a body that many have\nand one more line of words", ["x", "y"], "s", dt.date(2024, 1, 1), None, None, False) for i in range(60)]
    notes = spark.createDataFrame(rows, NOTE)
    marks = D.marked(notes)
    made = D.scored(notes, D.candidates(notes, marks), marks, units=False)
    assert made.count() == 3000
    texts = next(x for x in _leaves(made._jdf.queryExecution().optimizedPlan(), "FlatMapCoGroupsInPandas"))
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, texts.right()).count() <= 60 * 2 * spark.sparkContext.defaultParallelism
    full = {(r.left, r.right): (r.raw, r.same) for r in D.compared(notes).collect()}
    assert full == {(r.left, r.right): (r.raw, r.same) for r in made.collect()}


def _leaves(plan, name):
    if plan.nodeName() == name:
        yield plan
    for k in range(plan.children().size()):
        yield from _leaves(plan.children().apply(k), name)


def test_index_is_shuffled_once(spark, tmp_path, monkeypatch):
    """Counts of all fields, over more files than buckets; a note's tokens are counted without a shuffle."""
    from tessella.operators import index as I

    monkeypatch.setattr(I, "NOTES_A_FILE", 10)
    rows = [(i, f"t{i % 3} x", f"word{i % 5} 한국어 x", f"x x word{i % 7}\nlong{i}" if i % 9 else None, ["b", "a"], "s") for i in range(45)]
    notes = spark.createDataFrame(rows, "id long, title string, summary string, body string, tags array<string>, scope string")
    assert "Exchange" not in I.gathered(notes)._jdf.queryExecution().executedPlan().toString()
    I.build(notes, f"{tmp_path}/i")
    tokens = {r.id: r for r in I.field_tokens(notes).collect()}
    want = {(t, i, *[r[f].count(t) for f in I.FIELDS], *[len(r[f]) for f in I.FIELDS]) for i, r in tokens.items() for t in {x for f in I.FIELDS for x in r[f]}}
    index = I.Index(spark, f"{tmp_path}/i")
    got = index._postings.select("term", "id", *[f"{x}_{f}" for x in ("tf", "len") for f in I.FIELDS]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert index.statistics == {"n": 45} | {f: sum(len(r[f]) for r in tokens.values()) / 45 for f in I.FIELDS} and index.frequencies(["x", "none"], "title") == {"x": 45}


def test_nearest_compares_all_whatever_their_number(spark):
    """Exact neighbours of 3,300 vectors, over the number up to which all were compared; ties by id, zero vectors near nothing."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(3300, 8)).astype(np.float32)
    m[7], m[1200], m[5] = m[3000], m[3000], 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<float>")
    d = m.astype(float)
    with np.errstate(invalid="ignore"):
        cos = np.round(d @ d.T / np.outer(*[np.linalg.norm(d, axis=1)] * 2), 9)
    np.fill_diagonal(cos, np.nan)
    order = lambda i: sorted((j for j in np.flatnonzero(cos[i] >= 0.5)), key=lambda j: (-cos[i, j], j))[:3]
    got = {(r.id, r.place): r.other for r in V.nearest(v, 8, 3, least=0.5).collect()}
    assert got == {(i, n): j for i in range(3300) for n, j in enumerate(order(i), 1)}
    asked = N.cosine_topk(v, v.where("id % 100 = 0").toDF("query", "q"), 3)
    assert {(r.query, r.place): (r.id, r.cos) for r in asked.collect()} == {(i, n): (j, cos[i, j]) for i in range(0, 3300, 100) for n, j in enumerate(sorted((j for j in range(3300) if cos[i, j] > -2), key=lambda j: (-cos[i, j], j))[:3], 1)}


def test_a_budget_looks_at_the_head_only(spark):
    """Prefixes as by trying all of them, and in a time that long texts do not change."""
    import time

    from tessella.functions import text as X

    texts = ["", "가" * 40, "a가" * 30, "x" * 33, "x" * 34, "가" + "x" * 200, "x" * 30 + "漢" * 9]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    cost = lambda t: -(-sum(72 if "가" <= c <= "힣" or c == "漢" else 30 for c in t) // 100)
    want = [max((t[:k] for k in range(len(t) + 1) if cost(t[:k]) <= 10), key=len) for t in texts]
    assert [r[0] for r in rows.select(X.within_budget(F.col("t"), 10)).collect()] == [*want, None]
    long = spark.range(300).select(F.repeat(F.lit("words and 단어 "), 8000).alias("t"))
    began = time.time()
    assert long.select(F.max(F.length(X.within_budget(F.col("t"), 200)))).first()[0] > 500
    assert time.time() - began < 20


def test_decision_gate_makes_no_row_a_pair(spark, monkeypatch):
    """The rival most alike, ties to the smaller id, by all pairs; its plan joins no pairs."""
    monkeypatch.setattr(D, "SHARE", 15)
    rng = np.random.default_rng(11)
    said = ["use the index", "drop the index", "keep two copies", "keep three copies of all", "", "x"]
    rows = [(i, "decision" if i % 5 else "fact", said[rng.integers(5)], said[rng.integers(6)], "b", [t for t in "abc" if rng.random() < 0.8] or ["a"], f"s{i % 3}" if i % 13 else None, dt.date(2024, 1, 1), 1 if i % 7 == 0 else None, None, False) for i in range(80)]
    notes = spark.createDataFrame(rows, NOTE)
    grams = lambda r: {t[k : k + 3] for k in range(max(1, len(t) - 2))} if (t := D.normal(f"{r[2] or r[3][:40]} {r[3]}")) else set()
    want = set()
    for a in rows:
        near = [(-round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 9), b[0]) for b in rows if a[1] == b[1] == "decision" and a[0] % 4 == 1 and a[0] != b[0] and a[6] and a[6] == b[6] and b[8] is None and len({*a[5]} & {*b[5]}) >= 2 and grams(a) | grams(b)]
        if near and min(near)[0] <= -0.04:
            want.add((a[0], min(near)[1], -min(near)[0]))
    got = D.decision_gate(notes.where("id % 4 = 1"), notes, "2025-02-10")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_review_queues_read_the_rules_once(spark):
    """Findings are worked out once, whatever reads them; shadowed ones are dropped."""
    from tessella.operators import rules as R

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = [("C05", 1), ("C08", 1), ("C05", 2), ("E01", 3), ("C18", 4), ("none", 5)]
    findings = spark.createDataFrame(rows, "rule string, id long").coalesce(1).mapInPandas(counted, "rule string, id long")
    got = {(r.kind, r.place, r.rule, r.id) for r in R.review_queues(findings).collect()}
    assert got == {("supersede", 1, "C08", 1), ("conflict", 1, "C05", 2), ("security", 1, "E01", 3), ("retired", 1, "C18", 4)}
    assert seen.value == len(rows)
