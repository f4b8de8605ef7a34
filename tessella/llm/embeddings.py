"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Cells come in two levels: k-means on the driver over a bounded sample of all vectors, and in cells that are still large
another k-means on executors, over a bounded sample of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import kept_fields, schema, written
from tessella.llm.components import connected_components
from tessella.llm.simhash import forest


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit rows x; an empty cell takes the row that fits its own worst."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        own, fit = s.argmax(1), s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        for empty in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            worst = int(fit.argmin())
            sums[empty], fit[worst] = x[worst], 2
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _assign(cells: dict, reach: float, names: list[str], out: pa.Schema, fan: int):
    """Each vector at home in its nearest cell, and as a guest in every other cell that may hold one of its neighbours.

    If y is within `reach` of x and nearer to centroid c than to x's own centroid h, then x.(h - c) <= reach |h - c|. Cells
    are looked up by the columns `names`; a cell number is `fan` times the number before, plus the place of the centroid.
    Guests of a cell are guests of its parts.
    """

    def run(batches):
        for b in batches:
            keys = list(zip(*(b.column(n).to_pylist() for n in names), strict=True))
            for key in dict.fromkeys(keys):
                at = np.flatnonzero([k == key for k in keys])
                part = b.take(pa.array(at))
                old, stranger = part.column("cell").to_numpy(), part.column("guest").to_numpy(zero_copy_only=False)
                if key not in cells:
                    where, cell, guest = np.arange(len(at)), old * fan, stranger
                else:
                    c = cells[key]
                    s = _unit(_matrix(part.column("vector"))) @ c.T
                    home = s.argmax(1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                    near = s.max(1)[:, None] - s <= reach * apart[home] + 1e-9
                    near[np.arange(len(at)), home] = True
                    where, cell = np.nonzero(near)
                    guest = (cell != home[where]) | stranger[where]
                    cell = old[where] * fan + cell
                t = pa.Table.from_batches([part]).drop_columns(["cell", "guest"]).take(pa.array(where))
                yield from pa.Table.from_arrays([*t.columns, pa.array(cell, pa.int64()), pa.array(guest)], schema=out).to_batches(max_chunksize=10_000)

    return run


def _centroids(k: int):
    """Centroids of one cell's sample, a row each."""

    def run(t: pa.Table) -> pa.Table:
        x = _unit(_matrix(t.column("vector").combine_chunks()))
        c = spherical_kmeans(x, max(1, min(k, len(x) // 4)))
        one = [t.column(n).slice(0, 1).to_pylist()[0] for n in ("label", "dim", "cell")]
        return pa.table({"label": pa.array([one[0]] * len(c), t.column("label").type), "dim": pa.array([one[1]] * len(c), pa.int32()), "cell": pa.array([one[2]] * len(c), pa.int64()), "centroid": pa.array(list(c), pa.list_(pa.float64()))})

    return run


def _compare(least: float):
    """For a block of home vectors against a block of members: links by copies counted, and spanning edges."""

    def run(t: pa.Table) -> pa.Table:
        gid, copies = t.column("gid").to_numpy(), t.column("copies").to_numpy()
        raw = _matrix(t.column("vector").combine_chunks())
        unit = _unit(raw)
        homes, members = np.flatnonzero(t.column("as_home").to_numpy()), np.flatnonzero(t.column("as_member").to_numpy())
        s = unit[homes] @ unit[members].T
        i, j = np.nonzero(s >= least - 1e-9)
        score = s[i, j]
        i, j = homes[i], members[j]
        close = np.flatnonzero(np.abs(score - least) <= 1e-9)  # the same for a pair, whichever is at home
        a, b = raw[i[close]], raw[j[close]]
        score[close] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        good = (score >= least) & (i != j)
        i, j = i[good], j[good]
        links = np.bincount(i, weights=copies[j], minlength=len(gid)).astype(np.int64)
        label = forest(len(gid), [(i, j)])
        tied = np.flatnonzero(label != np.arange(len(gid)))
        seen = np.flatnonzero(links)
        to = np.concatenate([np.full(len(seen), -1), gid[label[tied]]])
        return pa.table({"gid": np.concatenate([gid[seen], gid[tied]]), "links": np.concatenate([links[seen], np.zeros(len(tied), np.int64)]), "to": pa.array(to, mask=to < 0)})

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, cell_rows: int = 2000, sample_rows: int = 20_000, most_labels: int = 10_000, parts: int = 32, part_sample: int = 1024, block: int = 1024) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal, not null label and equal length are linked at cosine >= least, in double precision; n_links
    counts the other vectors linked directly, component_id is the smallest id that links reach, kept tells whether that
    is the vector's own. Vectors that are null, empty or zero or hold nulls or non-finite numbers are alone. Null ids
    never count as smallest; rows of a component without any id are all kept. Equal vectors of a label are compared
    once and counted as often as they are there; repeated rows are so many vectors. An empty table gives no rows.

    Cells come from k-means over a sample of at most sample_rows distinct vectors (smallest by hash), for the most_labels
    largest labels, two cells at least; every vector is then assigned, and compared with all vectors that may be near by a
    bound that loses none. Labels of fewer than eight sampled vectors are one cell. A cell of over four times cell_rows
    is cut into `parts` by k-means over about part_sample of its vectors. A cell is compared in pairs of blocks, so that
    no task holds more than two blocks, however large the cell.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # equal vectors of a label have equal 128-bit hashes, which stand for them from here on
    h1, h2 = F.xxhash64("label", "vector"), F.xxhash64(F.lit(7), "vector", "label")
    rows = written(rows.withColumn("sound", sound).withColumns({"h1": h1, "h2": h2}), "vectors")
    good = rows.where("sound")
    distinct = good.groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.count("*").alias("copies"), F.min("_id").alias("least"))
    groups = written(distinct.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("gid")), "groups")
    large = groups.groupBy("label", "dim").count().where("count >= 8").orderBy(F.desc("count"), "label", "dim").limit(most_labels).collect()
    wanted = {(r["label"], r["dim"]): max(2, math.ceil(r["count"] / cell_rows)) for r in large}
    cells = {}
    if wanted:
        sampled: dict = {}
        for r in groups.orderBy("h1", "h2").limit(sample_rows).select("label", "dim", "vector").collect():
            sampled.setdefault((r.label, r.dim), []).append(r.vector)
        for key, k in wanted.items():
            x = np.array(sampled.get(key, []))
            if len(x) >= 8:
                cells[key] = spherical_kmeans(_unit(x), max(1, min(k, len(x) // 4)))
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = groups.select("gid", "copies", "label", "dim", "vector", F.lit(0).cast("long").alias("cell"), F.lit(False).alias("guest"))
    out = schema(*kept_fields(plain, plain.columns))
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    wide = max(map(len, cells.values()), default=1)
    placed = written(plain.mapInArrow(_assign(cells, reach, ["label", "dim"], to_arrow_schema(out), wide), out), "cells")
    key = ["label", "dim", "cell"]
    big = placed.where("NOT guest").groupBy(*key).count().where(F.col("count") > 4 * cell_rows).orderBy(F.desc("count"), *key).limit(sample_rows // 4)
    big = written(big, "big")
    if big.head(1):
        share = F.pmod(F.xxhash64(F.lit(3), "gid"), F.greatest(F.lit(1), F.floor(F.col("count") / part_sample))) == 0
        few = placed.where("NOT guest").join(F.broadcast(big), key).where(share).select(*key, "vector")  # as many rows as cells of the first level
        inner: dict = {}
        label = dict(few.dtypes)["label"]
        for r in few.groupBy(*key).applyInArrow(_centroids(parts), f"label {label}, dim int, cell long, centroid array<double>").collect():
            inner.setdefault((r["label"], r["dim"], r["cell"]), []).append(r["centroid"])
        inner = {k: np.array(c) for k, c in inner.items()}
        placed = written(placed.mapInArrow(_assign(inner, reach, key, to_arrow_schema(out), parts), out), "parts")
    sizes = written(placed.groupBy(*key).agg(F.ceil(F.sum(F.when(F.col("guest"), 0).otherwise(1)) / block).cast("int").alias("hbs"), F.ceil(F.count("*") / block).cast("int").alias("mbs")), "sizes")
    sized = placed.join(sizes, key)
    h = F.xxhash64("gid")
    own_h, own_m = F.pmod(h, F.greatest("hbs", F.lit(1))).cast("int"), F.pmod(F.shiftright(h, 20), F.col("mbs")).cast("int")
    units = sized.withColumn("hb0", own_h).withColumn("mb0", own_m).where("hbs > 0")
    as_member = "transform(sequence(0, hbs - 1), x -> named_struct('hb', x, 'mb', mb0, 'as_home', x = hb0 AND NOT guest, 'as_member', true))"
    as_home = "filter(transform(sequence(0, mbs - 1), x -> named_struct('hb', hb0, 'mb', x, 'as_home', true, 'as_member', false)), u -> u.mb <> mb0 AND NOT guest)"
    dealt = units.select("gid", "copies", "vector", *key, F.explode(F.expr(f"concat({as_member}, {as_home})")).alias("u")).select("gid", "copies", "vector", *key, "u.*")
    found = written(dealt.groupBy(*key, "hb", "mb").applyInArrow(_compare(least), "gid long, links long, to long"), "found")
    links = found.where("to is null").groupBy("gid").agg(F.sum("links").alias("links"))
    roots = written(connected_components(found.where("to is not null").select(F.col("gid").alias("a"), F.col("to").alias("b"))), "components")
    told = groups.select("h1", "h2", "gid", "copies", "least").join(links, "gid", "left").join(roots, F.col("gid") == F.col("node"), "left")
    told = written(told.select("h1", "h2", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", F.xxhash64("gid")).alias("root")), "told")
    smallest = told.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = told.join(smallest, F.col("root") == F.col("_root")).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    told = good.select("_id", "h1", "h2").join(named, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2"))).select("_id", "n_links", "component_id")
    alone = rows.where("not sound").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return told.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
