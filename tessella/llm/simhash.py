"""SimHash near-dedup: fingerprints, and their self-join as a walk down pairs of nodes of a binary trie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_broadcast, kept_fields, schema, written
from tessella.llm.components import connected_components

ONES = np.uint64(0x0101010101010101)
#: Bits of the trie's first step: a block of this many bits begins each of the rotations.
BLOCK = 16


def _hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return []
    norm, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(norm, 42)]
    starts, at = [0], -1
    ends = []
    for w in words:
        at += len(w) + 1
        ends.append(at)
        starts.append(at + 1)
    return [h(norm[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]


def simhash(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """A 64-bit fingerprint (uint64) per text: a bit is set if over half of the text's shingle hashes have it."""
    out, lists, where, held = np.zeros(len(texts), np.uint64), [], [], 0

    def flush() -> None:
        nonlocal held
        if not lists:
            return
        sizes = np.array([len(x) for x in lists])
        hashes = np.concatenate([np.array(x, np.uint64) for x in lists])
        begin = np.cumsum(sizes) - sizes
        chunks = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(begin, sizes, strict=True)])  # a byte counts to 255
        first = np.searchsorted(chunks, begin)
        bits = np.zeros((len(lists), 64), np.int64)
        for k in range(8):
            part = np.add.reduceat((hashes >> np.uint64(k)) & ONES, chunks).view(np.uint8).reshape(-1, 8)
            bits[:, k::8] = np.add.reduceat(part.astype(np.int64), first, axis=0)
        out[where] = np.packbits(2 * bits > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        lists.clear()
        where.clear()
        held = 0

    for i, t in enumerate(texts):
        if x := _hashes(t or b"", shingle):
            lists.append(x)
            where.append(i)
            held += len(x)
        if held > 200_000:
            flush()
    flush()
    return out


def _fingerprint(n: int, shingle: int, names: list[str]):
    def run(batches):
        for b in batches:
            fp = simhash(b.column("_text").cast(pa.binary()).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(fp.view(np.int64))], names)

    return run


def rotated(v: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    by = np.asarray(by, np.uint64) % np.uint64(64)
    return np.where(by == 0, v, (v << by) | (v >> ((np.uint64(64) - by) % np.uint64(64))))


def trie_pairs(v: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray, depth: int, left: np.ndarray, errors: int):
    """Index pairs (i, j) of values that differ in at most `errors` bits.

    v: sorted within each of the ranges [first, middle) and [middle, last), whose values have their first `depth` bits
    in common; left: errors that the two ranges' first bits leave. A range pair is joined with each other; middle ==
    last stands for one range joined with itself. The walk goes down one bit a step for all node pairs at once:
    children that differ in the bit pay for it, and a pair whose budget is exceeded goes. Small node pairs are compared
    directly.
    """
    own = middle == last
    a0, a1, b0, b1 = first, np.where(own, last, middle), np.where(own, first, middle), last
    while len(a0):
        small = ((a1 - a0) * (b1 - b0) <= 48) | (depth == 64)
        for at in np.array_split(np.flatnonzero(small), max(1, int(small.sum()) // 40_000)):
            wide = b1[at] - b0[at]
            cells = (a1[at] - a0[at]) * wide
            of = np.repeat(np.arange(len(at)), cells)
            k = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
            i, j = a0[at][of] + k // wide[of], b0[at][of] + k % wide[of]
            good = (np.bitwise_count(v[i] ^ v[j]) <= errors) & (i != j)
            yield i[good], j[good]
        if depth == 64:
            return
        a0, a1, b0, b1, left = (x[~small] for x in (a0, a1, b0, b1, left))
        ones = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0
        children = [(a0, am, b0, bm, left), (am, a1, bm, b1, left), (a0, am, bm, b1, left - 1), [x[other] for x in (am, a1, b0, bm, left - 1)]]
        a0, a1, b0, b1, left = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (left >= 0) & (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, left = (x[alive] for x in (a0, a1, b0, b1, left))
        depth += 1


def forest(n: int, pairs) -> np.ndarray:
    """Label of each of n nodes: the smallest node that the pairs connect it with."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (deeper := label[label]) is not None and (deeper != label).any():
                label = deeper
    return label


def _links(errors: int, buffer: int):
    """Spanning edges (a, b) of fingerprints linked within the node pairs of this partition, sorted by node pair and side."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        c = {k: t.column(k).to_numpy() for k in ("rot", "depth", "pa", "pb", "side", "v")}
        v = c["v"].view(np.uint64)
        key = np.stack([c["depth"], c["rot"], c["pa"], c["pb"]])
        first = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])
        last = np.append(first[1:], len(v))
        sides = np.concatenate([[0], np.cumsum(c["side"])])
        middle = last - (sides[last] - sides[first])
        cross = c["pa"][first] != c["pb"][first]
        useful = np.where(cross, (middle > first) & (middle < last), last - first > 1)
        first, middle, last, cross = first[useful], middle[useful], last[useful], cross[useful]
        budget = errors - np.bitwise_count(c["pa"][first] ^ c["pb"][first]).astype(np.int64)
        label = np.arange(len(v))
        for d in np.unique(c["depth"][first]):
            x = c["depth"][first] == d
            label = np.minimum(label, forest(len(v), trie_pairs(v, first[x], middle[x], last[x], int(d), budget[x], errors)))
        i = np.flatnonzero(label != np.arange(len(v)))
        plain = rotated(v, 64 - c["rot"].astype(np.uint64) * np.uint64(BLOCK)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(plain[i]), pa.array(plain[label[i]])], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= buffer:
                t = pa.Table.from_batches(held)
                key = np.stack([t.column(k).to_numpy() for k in ("depth", "rot", "pa", "pb")])
                turn = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
                if len(turn):  # the last node pair may go on in the next batch
                    yield solve(t.slice(0, int(turn[-1]) + 1))
                    held = t.slice(int(turn[-1]) + 1).to_batches()
                    rows = sum(x.num_rows for x in held)
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def hamming_links(fps: DataFrame, errors: int = 3, least_split: int = 2048) -> DataFrame:
    """Edges (a, b) that connect all of the distinct 64-bit values in fps(fp) that differ in `errors` bits or fewer.

    Two such values agree in at least one of 64 / 16 = 4 blocks of 16 bits, so the trie is walked once for each of the
    four rotations that put a block first, and there only node pairs with an equal first block matter (this holds for
    errors < 4). Nodes are dealt out by that block. A node with many more values than the mean, as a large group of
    near copies makes it, is split into its children's node pairs four bits at a time, on the cluster, until no node
    pair has more values than the limit. Links are joined to spanning trees within a task: no pairs of a group are
    emitted.
    """
    if not 0 <= errors < 64 // BLOCK:
        raise ValueError("errors must be below the number of blocks")
    n = fps.count()
    limit = max(least_split, 8 * n >> BLOCK)
    turned = F.array(*[F.struct(F.lit(r).alias("rot"), F.expr(f"shiftleft(fp, {r * BLOCK}) | shiftrightunsigned(fp, {64 - r * BLOCK})" if r else "fp").alias("v")) for r in range(64 // BLOCK)])
    top = F.shiftrightunsigned("v", 64 - BLOCK)
    pairs = fps.select(F.explode(turned).alias("x")).select("x.*")
    pairs = pairs.select(F.lit(BLOCK).alias("depth"), "rot", top.alias("pa"), top.alias("pb"), F.lit(0).alias("side"), "v")
    node, done, depth = ["depth", "rot", "pa", "pb"], [], BLOCK
    near = {c: [o for o in range(16) if (c ^ o).bit_count() <= errors] for c in range(16)}
    while True:
        hot = written(pairs.groupBy(*node).count().where(F.col("count") > limit).drop("count"), "hot")
        if depth >= 64 or not hot.head(1):
            done.append(pairs)
            break
        hot_side = bounded_broadcast(hot, 100_000)
        done.append(pairs.join(hot_side, node, "left_anti"))
        child = F.shiftrightunsigned("v", 60 - depth).bitwiseAND(F.lit(15))
        options = F.element_at(F.array(*[F.array(*map(F.lit, near[c])) for c in range(16)]), (child + 1).cast("int"))
        mine = F.shiftleft(F.when(F.col("side") == 0, F.col("pa")).otherwise(F.col("pb")), 4).bitwiseOR(child)
        split = pairs.join(hot_side, node, "left_semi").withColumn("o", F.explode(options)).withColumn("mine", mine)
        same = F.col("pa") == F.col("pb")
        theirs = F.shiftleft(F.when(same | (F.col("side") == 1), F.col("pa")).otherwise(F.col("pb")), 4).bitwiseOR(F.col("o"))
        split = split.withColumn("theirs", theirs)
        first = F.when(same, F.col("mine") <= F.col("theirs")).otherwise(F.col("side") == 0)
        pairs = written(
            split.select(
                (F.col("depth") + 4).alias("depth"), "rot", F.when(first, F.col("mine")).otherwise(F.col("theirs")).alias("pa"),
                F.when(first, F.col("theirs")).otherwise(F.col("mine")).alias("pb"), F.when(first, 0).otherwise(1).alias("side"), "v",
            ).where(F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= errors),
            "nodes",
        )
        depth += 4
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    return every.repartition(*node).sortWithinPartitions(*node, "side", F.col("v") < 0, "v").mapInArrow(_links(errors, 200_000), "a bigint, b bigint")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, shingle: int = 3, errors: int = 3) -> DataFrame:
    """One row per document: id, the carried columns, fingerprint (16 hex digits), component_id, component.

    Words are cut at ASCII white space after lower-casing A-Z; shingles of `shingle` words are hashed with XXH64. A text
    with fewer words is one shingle, a null, empty or blank one has fingerprint zero, which links like any other.
    Fingerprints at `errors` or fewer differing bits are linked; component_id is the smallest id that links reach, the
    document's own included. Null ids never count as smallest; a component of null ids only has a null component_id, so
    that `component` is what tells components apart.
    Repeated rows are told one by one. An empty table gives no rows; extra columns of docs do not matter.
    """
    carry = carry or []
    held = [f"_c{i}" for i in range(len(carry) + 1)]
    source = docs.select(*[F.col(c).alias(h) for c, h in zip([id_col, *carry], held, strict=True)], F.col(text_col).cast("string").alias("_text"))
    out = schema(*kept_fields(source, held), ("fp", T.LongType()))
    rows = written(source.mapInArrow(_fingerprint(len(held), shingle, [*held, "fp"]), out), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("_c0").alias("least")), "prints")
    roots = written(connected_components(written(hamming_links(prints.select("fp"), errors), "links")), "components")
    rooted = written(
        prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", F.xxhash64("fp")).alias("root")), "rooted"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = written(rooted.join(written(least, "least"), F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id", F.col("root").alias("component")), "named")
    names = [F.col(h).alias(c) for c, h in zip([id_col, *carry], held, strict=True)]
    return rows.join(named, F.col("fp") == F.col("_fp")).select(*names, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")
