import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from tessella.llm.simhash import hamming_links, rotated, simhash, simhash_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def plain_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, errors=3):
    values = sorted(values)
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= errors:
                up[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", None, " \n", "One", "one two", "ÄB cd EF", "a b c " * 700] + [" ".join(rng.choice("abc de f gh".split()) for _ in range(rng.randrange(1, 900))) for _ in range(20)]
    got = simhash([t.encode() if t is not None else None for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


def check_links(spark, values, **kw):
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    rows = hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), **kw).collect()
    want = components(values)
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in rows:
        a, b = r.a % 2**64, r.b % 2**64
        assert want[a] == want[b]
        up[find(a)] = find(b)
    assert len({find(v) for v in values}) == len(set(want.values()))


def test_links_and_hot_nodes(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(1, 6))}))
    check_links(spark, values)
    centre = rng.getrandbits(64)
    crowd = {centre ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(0, 9))}) for _ in range(400)}
    check_links(spark, values | crowd, least_split=20)


def test_rotation():
    v = np.array([1, 2**63, 2**64 - 1], np.uint64)
    assert rotated(rotated(v, 16), 48).tolist() == v.tolist()
    assert rotated(v, 64).tolist() == v.tolist()


def test_documents(spark):
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    rows = [(1, base, "x"), (2, base + " tail", "x"), (3, "other words here now", None), (4, None, None), (5, "", "y"), (None, base, None), (5, "", "y"), (None, "lonely", None)]
    got = simhash_dedup(spark.createDataFrame(rows, DOCS)).collect()
    comp = sorted(((str(r.doc_id), r.component_id) for r in got), key=str)
    assert comp == sorted([("1", 1), ("2", 1), ("3", 3), ("4", 4), ("5", 4), ("5", 4), ("None", 1), ("None", None)], key=str)
    assert simhash_dedup(spark.createDataFrame([], DOCS)).collect() == []
