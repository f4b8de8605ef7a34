import numpy as np
from pyspark.sql import types as T

from tessella.llm.embeddings import embedding_dedup

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("gid", T.StringType())])


def brute(rows, least=0.98):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and lab is not None for _, v, lab, _ in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    links[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((str(rows[i][0]), len(links[i]), least_id, rows[i][0] == least_id))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])).tolist(), int(i % 12 == 5) + 2 * int(i % 3 == 0), "x") for i in range(400)]
    chain = [[np.cos(t), np.sin(t), *[0.0] * 6] for t in np.arange(40) * 0.15]
    rows += [(1000 - i, list(map(float, x)), 0, None) for i, x in enumerate(chain)]
    same = [float(x) for x in centres[0]]
    rows += [(2000 + i, same, 0, "x") for i in range(150)] + [(2000, same, 0, "x"), (None, same, 0, "x")]
    rows += [(3000, None, 0, "x"), (3001, [0.0] * 8, 0, "x"), (3002, [1.0, None] + [0.0] * 6, 0, "x"), (3003, [float("nan")] * 8, 0, "x"), (3004, same, None, "x"), (3005, [1.0, 2.0], 0, "x"), (3006, [2.0, 4.0], 0, "x"), (3007, [], 0, "x"), (None, [9.0, -2.0], 0, "x")]
    want = sorted(brute(rows), key=str)
    got = embedding_dedup(spark.createDataFrame(rows, VECTORS), cell_rows=30, block=16).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == want
    assert embedding_dedup(spark.createDataFrame([], VECTORS)).collect() == []


def test_two_levels_of_cells(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + rng.normal(size=8) * rng.choice([0.03, 0.15])).tolist(), 1, "x") for i in range(700)]
    got = embedding_dedup(spark.createDataFrame(rows, VECTORS), cell_rows=20, sample_rows=24, parts=4, part_sample=40, block=32).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == sorted(brute(rows), key=str)
