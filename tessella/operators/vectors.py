"""Vectors in search and linking: stored int8 rows, static word vectors, LSH neighbours, cosine lists and blends."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import vectors as V
from tessella.operators.neighbours import cosine_topk

#: Least cosine of a list, weight of the vector list, window of a blend, flatness.
FLOOR, WEIGHT, WINDOW, FLAT = 0.35, 1.5, 5, 0.25
#: Share of each field in a note's static vector.
SHARES = {"title": 2.0, "meta": 1.0, "summary": 2.0, "body": 1.0}
_MASK = (1 << 64) - 1


def stored(vectors: DataFrame, recipe: str = "") -> DataFrame:
    """(id, q, scale, key) of vectors(id, v, hash): int8 values with their scale, and the digest of content and recipe they were made from."""
    packed = V.quantise(F.col("v"))
    return vectors.select("id", packed["q"].alias("q"), packed["scale"].alias("scale"), F.sha2(F.concat_ws("\n", "hash", F.lit(recipe)), 256).alias("key"))


def loaded(rows: DataFrame) -> DataFrame:
    """(id, v) of stored rows, as floats again."""
    return rows.select("id", V.dequantise(F.col("q"), F.col("scale")).alias("v"))


def stale(notes: DataFrame, rows: DataFrame, recipe: str = "") -> DataFrame:
    """Notes(id, hash, ...) whose vector is missing or was made from other content or by another recipe."""
    key = F.sha2(F.concat_ws("\n", "hash", F.lit(recipe)), 256)
    return notes.withColumn("_key", key).join(rows.select("id", F.col("key").alias("_key")), ["id", "_key"], "left_anti").drop("_key")


def rebuilt(notes: DataFrame, rows: DataFrame, encode: Callable[[list[str]], list], text: Column, recipe: str = "", batch: int = 64) -> DataFrame:
    """Stored rows of all notes: those that are still good, and new ones for what changed, encoded in batches.

    encode: a function of a list of texts that returns their vectors; texts begin with `passage: `, and control signs are
    taken out first. Rows of notes that are gone go.
    """
    kind = dict(notes.dtypes)["id"]
    asked = stale(notes, rows, recipe).select("id", "hash", F.concat(F.lit("passage: "), clean(text)).alias("text"))

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                yield pd.DataFrame({"id": part["id"], "hash": part["hash"], "v": [list(map(float, x)) for x in encode(part["text"].tolist())]})

    made = stored(asked.mapInPandas(run, f"id {kind}, hash string, v array<double>"), recipe)
    key = F.sha2(F.concat_ws("\n", "hash", F.lit(recipe)), 256)
    kept = rows.join(notes.select("id", key.alias("key")), ["id", "key"], "left_semi").select("id", "q", "scale", "key")
    return kept.unionByName(made)


def clean(text: Column) -> Column:
    """Terminal sequences and control signs out, white space to single spaces."""
    plain = F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"[\p{Cc}\p{Cf}]", " "), r"\s+", " "))


def hyperplanes(dim: int, seed: int = 88172645463325252) -> np.ndarray:
    """64 planes of +-1 by a xorshift generator, the same on every machine."""
    state, out = seed, np.empty((64, dim))
    for i in range(64):
        for j in range(dim):
            state ^= state << 13 & _MASK
            state ^= state >> 7
            state ^= state << 17 & _MASK
            out[i, j] = (state >> 11) / float(1 << 53) * 2 - 1
    return out


def signs(vector: Column, dim: int) -> Column:
    """The 64 side bits of a vector."""

    @F.pandas_udf(T.LongType())
    def run(v: pd.Series) -> pd.Series:
        m = np.stack(v.map(lambda x: np.asarray(x, np.float64)).tolist()) if len(v) else np.empty((0, dim))
        bits = (m @ hyperplanes(dim).T) > 0
        return pd.Series(np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel())

    return run(vector)


def nearest(vectors: DataFrame, dim: int, k: int = 8, least: float = 0.0) -> DataFrame:
    """(id, other, cos, place): each vector's k nearest of all vectors(id, v), at the least cosine or above; exact at any size."""
    rows = vectors.select("id", "v").where(F.size("v") == dim)
    return cosine_topk(rows, rows.toDF("query", "q"), k, least).select(F.col("query").alias("id"), F.col("id").alias("other"), "cos", "place")


def _of_field(name: str) -> Callable:
    return lambda t: F.struct(F.lit(name).alias("field"), t.alias("term"))


def static_vectors(notes: DataFrame, table: DataFrame, tokens: dict[str, Column]) -> DataFrame:
    """(id, v): each field's unit sum of weighted word vectors, mixed by SHARES, to unit length. table(term, weight, v).

    Words meet the table in a join and sums are combined by dimension, so that no task holds the table; a note without
    any word of the table has no row.
    """
    each = F.flatten(F.array(*[F.transform(column, _of_field(f)) for f, column in tokens.items()]))
    uses = notes.select("id", F.explode(each).alias("x")).groupBy("id", F.col("x.field").alias("field"), F.col("x.term").alias("term")).agg(F.count("*").alias("uses"))
    parts = uses.join(table, "term").select("id", "field", F.posexplode(F.transform("v", lambda x: x * F.col("weight") * F.col("uses"))).alias("d", "x"))
    sums = parts.groupBy("id", "field", "d").agg(F.sum("x").alias("x"))
    norms = sums.groupBy("id", "field").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in SHARES.items() for x in (k, v)]), F.col("field"))
    mixed = sums.join(norms, ["id", "field"]).groupBy("id", "d").agg(F.sum(share * F.col("x") / F.col("norm")).alias("x"))
    whole = mixed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return whole.select("id", V.unit(F.col("v")).alias("v"))


def cosine_list(candidates: DataFrame, vectors: DataFrame, query: list[float], floor: float = FLOOR) -> DataFrame:
    """(id, cos, rank) of candidates(id) at the floor or above, for one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.join(candidates.select("id").distinct(), "id", "left_semi").select("id", F.round(V.cosine(F.col("v"), q), 9).alias("cos")).where(F.col("cos") >= floor)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cos"), "id")))  # of a query's candidates


def blended(fused: DataFrame, cosines: DataFrame, softener: float = 10.0, weight: float = WEIGHT) -> DataFrame:
    """(id, rrf): fused(id, rrf) with the vector list added at weight / (softener + rank); the list only lifts what is there."""
    more = cosines.select("id", (weight / (softener + F.col("rank"))).alias("lift"))
    return fused.join(more, "id", "left").select("id", F.round(F.col("rrf") + F.coalesce("lift", F.lit(0.0)), 9).alias("rrf"))


def flat(fused: DataFrame, k: int = WINDOW, least: float = FLAT) -> DataFrame:
    """One row, flat: whether the k-th score is within a quarter of the first, so that words alone do not tell hits apart."""
    first = F.slice(F.sort_array(F.collect_list("rrf"), asc=False), 1, k)
    top = fused.orderBy(F.desc("rrf"), "id").limit(k).agg(first.alias("s"))
    return top.select(F.coalesce((F.size("s") >= k) & (F.col("s")[0] > 0) & ((F.col("s")[0] - F.get("s", F.lit(k - 1))) / F.col("s")[0] < least), F.lit(False)).alias("flat"))


def remixed(fused: DataFrame, cosines: DataFrame, alpha: float, window: int = 50) -> DataFrame:
    """(id, rrf): the first `window` scores as alpha x words + (1 - alpha) x cosine, both min-max scaled, mapped back to their band."""
    top = fused.orderBy(F.desc("rrf"), "id").limit(window).join(cosines.select("id", "cos"), "id", "left")
    every = Window.partitionBy()  # of a window's rows
    low, high = F.min("rrf").over(every), F.max("rrf").over(every)
    near, far = F.max("cos").over(every), F.min("cos").over(every)
    words = F.when(high > low, (F.col("rrf") - low) / (high - low)).otherwise(1.0)
    meaning = F.when(near > far, (F.coalesce("cos", far) - far) / (near - far)).otherwise(0.0)
    mixed = top.select("id", F.round(low + (high - low) * (alpha * words + (1 - alpha) * meaning), 9).alias("rrf"))
    return fused.join(mixed.select("id"), "id", "left_anti").unionByName(mixed)

