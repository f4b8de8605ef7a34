import hashlib
import random

import numpy as np
from pyspark.sql import types as T

from tessella.llm import exact_dedup as module
from tessella.llm.components import connected_components
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.golomb import golomb_decode, golomb_encode

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("sha", T.StringType()), ("kept", T.StringType()))])


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, span in ((0, 10), (1, 1), (1, 2**48), (5, 5), (300, 2**40), (1000, 1001), (2000, 10**6)):
        values = np.sort(rng.choice(span, n, replace=False)) if span <= 10**6 else np.unique(rng.integers(0, span, n))
        coded = golomb_encode(values, span)
        assert golomb_decode(coded).tolist() == values.tolist()
        if n == 300:
            assert len(coded) < 6 * n


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(6))) for _ in range(40)] + ["x" * 50_000, "x y" * 9000]
    rows = [(i if i != 11 else None, rng.choice(pool) if i % 17 else None, "clash", "clash") for i in range(300)]
    rows += [(5, rows[5][1], "clash", None), (900, "é​ only", "a", "b"), (901, "é​only", "a", "b"), (902, " only", "a", "b"), (903, "only", "a", "b")]
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    got = exact_dedup(spark.createDataFrame(rows, DOCS).repartition(5), owners=3).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = [(str(i), min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3])) or sorted(map(str, [(str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(str, want))
    assert sum(r.kept for r in got) == len(groups) and all(r.keep_id == r.doc_id for r in got if r.kept)
    assert exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_senders_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "SENT", 3)  # the driver's value is read when the function is shipped
    rows = [(i, f"t{i % 7}", "a", "b") for i in range(60)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS).coalesce(1), owners=2).collect()
    assert sorted(r.doc_id for r in got if r.kept) == list(range(7)) and {r.group_size for r in got} == {8, 9}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(120)] + [(7, 7), (-3, -4)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {x for e in edges for x in e}
    assert len(set(got.values())) == len({find(x) for x in got}) and all(got[a] == got[b] for a, b in edges)
