import random

from pyspark.sql import types as T

import corpus_pipeline
from tessella.llm.near import near_groups
from tests.llm.test_simhash import components, plain_fingerprint

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType())])


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_roots(texts, similarity=(4, 5)):
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    s = [sets(t) for t in texts]
    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) * similarity[1] >= len(s[i] | s[j]) * similarity[0]:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(s))]


def planted():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(12))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(3, 200))]
        texts = [base] if rng.random() < 0.3 else [base, *[list(base) for _ in range(3)]]
        for t in texts[1:]:
            for _ in range(rng.randrange(0, 2 + len(t) // 40)):
                t[rng.randrange(len(t))] = word()
            t += [word() for _ in range(rng.randrange(0, 1 + len(t) // 5))]
        rows += [" ".join(t) + (" " + passage if rng.random() < 0.5 else "") for t in texts]
    return rows + [None, "", " ", "one two", "One  two", passage, passage.upper()]


def test_recall_against_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component for r in near_groups(docs).collect()}
    want = near_roots(texts)
    assert len(got) == len(texts) and len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))
    narrow = components({plain_fingerprint(t) for t in texts})
    assert len({narrow[plain_fingerprint(t)] for t in texts}) > len(set(want)) + 10  # three bits of three-word shingles miss many
    assert near_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_stage(spark):
    base = [f"w{i * 7919 % 1000}" for i in range(120)]
    other = [*base[:100], *[f"u{i}" for i in range(10)]]  # 96 of 126 shingles: below
    near = [*base[:110], *[f"v{i}" for i in range(10)]]  # 106 of 126: above
    rows = [(1, " ".join(base), None), (2, " ".join(near), None), (3, " ".join(other), None)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()) == [1, 3]


def rows_made(spark, what, run):
    """Rows that each plan node whose description has `what` made while run() ran, and run's result."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before, made = store.executionsCount(), []
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    told = store.executionsList()
    for k in range(before, told.size()):
        e = told.apply(k).executionId()
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())):
                if what in node.desc() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return made, out


def test_large_group_is_not_joined_in_pairs(spark):
    """Edits of one text, many of them too far from all others: buckets of all members, of which most stay apart."""
    rng = random.Random(7)
    base = [f"w{i * 7919 % 1000}" for i in range(150)]
    rows = []
    for i in range(600):
        t = list(base)
        for at in rng.sample(range(150), i % 8):
            t[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t), None))
    made, got = rows_made(spark, "Join", lambda: {r.doc_id: r.component for r in near_groups(spark.createDataFrame(rows, DOCS)).collect()})
    want = near_roots([t for _, t, _ in rows])
    assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values())) > 200
    assert max(made) < sum(len(sets(t)) for _, t, _ in rows)
