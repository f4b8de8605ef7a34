import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.mixing import _hypergeometric, mix, mixed_documents, shards, splitting_tree

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("size", T.StringType()))])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(3)
    out = []
    for i in range(220):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "é", None, "tiny"])
        n = 3 if source == "tiny" else rng.randrange(0, 90) if i != 9 else 5000
        out.append((i if i != 4 else None, " ".join("w" * rng.randrange(1, 5) for _ in range(n)) if i % 20 else None, source, "x"))
    return [*out, out[10], out[10]]


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in order}
        capped |= over


def test_mix(spark):
    data = rows()
    docs = spark.createDataFrame(data, DOCS).repartition(5)
    mixed = mix(docs, carry=["source"], block_words=16, shard_blocks=32)
    got = mixed.collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for _, t, s, _ in data:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == sum(p.words for p in r.pieces)
        taken[r.source] += r.taken
        for p in range(4):  # within a pass no word is drawn twice
            spans = sorted((x["first"], x["first"] + x.words) for x in r.pieces if x["pass"] == p)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and all(0 <= a < b <= r["size"] for a, b in spans)
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
    again = mix(spark.createDataFrame(data[::-1], DOCS), carry=["source"], block_words=16, shard_blocks=32).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = shards(mixed).groupBy("shard").agg(F.sum("words").alias("n")).collect()
    assert sum(r.n for r in out) == sum(taken.values()) and len(out) > 4
    assert mix(spark.createDataFrame([], DOCS)).collect() == []
    assert [r.taken for r in mix(spark.createDataFrame([(1, "", "s", "x")], DOCS)).collect()] == [0]


@pytest.mark.parametrize(("good", "pop", "draws"), [(30, 100, 20), (70, 100, 60), (5, 1000, 400), (2, 5, 3), (1, 2, 1)])
def test_hypergeometric_law(spark, good, pop, draws):
    n = 4000
    sql = _hypergeometric("good", "pop", "draws", ["7", "id", "1"])
    got = [r[0] for r in spark.range(n).selectExpr(f"{good}L good", f"{pop}L pop", f"{draws}L draws", "id").selectExpr(sql).collect()]
    assert min(got) >= max(0, draws + good - pop) and max(got) <= min(good, draws)
    mean, var = draws * good / pop, draws * good / pop * (1 - good / pop) * (pop - draws) / max(1, pop - 1)
    m = sum(got) / n
    assert abs(m - mean) < 5 * math.sqrt(var / n) + 1e-9
    assert abs(sum((x - m) ** 2 for x in got) / n - var) < 0.12 * var + 0.01


@pytest.mark.parametrize("width", [1000, 2])
def test_tree_is_exact(spark, width):
    quotas = {0: 1000, 1: 0, 2: 37, 3: 512}
    got = splitting_tree(spark.createDataFrame(list(quotas.items()), "rank long, draws long"), 4, 1, width).collect()
    assert all(sum(r.draws for r in got if r["rank"] == k) == n for k, n in quotas.items())
    loads = [sum(r.draws for r in got if r.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 1 and min(r.draws for r in got) > 0


def drawn_by_hand(order, leaves, sizes, block):
    """Words that shards draw of each (source, place on its line), by walking all passes block by block."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want, out = targets(sizes), {}
    for k, s in enumerate(names):
        z, words = sizes[s], round(want[s])
        if not z:
            continue
        blocks = max(1, z // block)
        passes, rest = divmod(words, z)
        few = min(-(-rest // block), blocks)
        factor = 1_000_003 if blocks % 1_000_003 else 999_983
        by_place = {factor * (b + 1) % blocks: b for b in range(blocks)}
        q = [next((r.draws for r in leaves if r["rank"] == k and r.shard == shard), 0) for shard in range(8)]
        assert sum(q) == passes * blocks + few
        taken = [0] * z
        at, last = 0, 0
        for shard, n in enumerate(q):
            full = max(0, min(at + n, passes * blocks) - min(at, passes * blocks))
            for place in range(min(at, passes * blocks), min(at, passes * blocks) + full):
                b = by_place[place % blocks]
                for w in range(b * block, z if b == blocks - 1 else (b + 1) * block):
                    taken[w] += 1
            f = n - full
            if f:
                begin = blocks * last // few
                assert begin + f <= blocks * (last + f) // few  # the shard's run has room for what it draws
                for place in range(begin, begin + f):
                    b = by_place[place]
                    for w in range(b * block, b * block + (block if b < blocks - 1 else rest - (few - 1) * block)):
                        taken[w] += 1
            last, at = last + f, at + n
        at = 0
        for i, size in order[s]:
            out.setdefault(i, []).append(sum(taken[at : at + size]))
            at += size
    return out


def test_shards_against_brute_force(spark):
    rng = random.Random(8)
    data = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choice("abcdef"), "x") for i in range(300)]
    docs = spark.createDataFrame(data, DOCS)
    sizes, order = defaultdict(int), defaultdict(list)
    for r in docs.select("doc_id", "text", "source", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(42)).alias("h")).orderBy("h").collect():
        n = len(r.text.split())
        order[r.source].append((r.doc_id, n))
        sizes[r.source] += n
    want = targets(sizes)
    quotas = []
    for k, s in enumerate(sorted(sizes)):
        blocks = max(1, sizes[s] // 16)
        passes, rest = divmod(round(want[s]), sizes[s])
        quotas.append((k, passes * blocks + min(-(-rest // 16), blocks)))
    leaves = splitting_tree(spark.createDataFrame(quotas, "rank long, draws long"), 3, 42).collect()
    total = sum(d for _, d in quotas)
    mixed = mix(docs, block_words=16, shard_blocks=-(-total // 8))
    got = {r.doc_id: r.taken for r in mixed.collect()}
    by_hand = drawn_by_hand(order, leaves, sizes, 16)
    assert got == {i: by_hand[i][0] for i in got}
    # another tree takes other words, by the same targets
    other = {r.doc_id: r.taken for r in mix(docs, block_words=16, shard_blocks=-(-total // 32)).collect()}
    assert other != got and abs(sum(other.values()) - sum(got.values())) <= len(sizes)


def test_documents_in_shard_order(spark):
    rows = [(i, " ".join(f"w{i}" for _ in range(40)), "ab"[i % 2], "x") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"size": "_key"}).withColumn("_pieces", F.lit("clash")).withColumn("_metadata", F.lit(1))
    mixed = mix(docs, block_words=64, shard_blocks=8)
    shard = {(r.doc_id, r.pieces[0].shard) for r in mixed.collect() if r.pieces}
    out = mixed_documents(docs, mixed, "doc_id")
    assert out.columns == docs.columns
    parts = out.select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in mixed.collect())
    place = defaultdict(set)
    for r in parts:
        place[next(s for i, s in shard if i == r.doc_id)].add(r.p)
    assert len(place) > 2 and all(place.values())
