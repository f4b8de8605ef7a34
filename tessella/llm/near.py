"""Near copies by the Jaccard similarity of their shingle sets, with no pair lost.

1. Shingles that occur in no other document: partitions send sorted, Golomb-coded lists to owners of hash ranges, and get
   bitmaps back. A document of which so many shingles are its own that no other can reach the similarity is done.
2. Of the rest, SimHash fingerprints are linked by the trie's self-join, and links are confirmed.
3. What is left is found by a prefix join: whatever order the shingles have, two similar sets share one of the first of
   each. The order is rare ones first, so that passages that many documents share come last. Groups are closed by stars
   first, each bucket's members against one of them, and only then by pairs of what is still apart, where the first
   shingle that two sets share leaves enough of either behind it.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import maybe_in, release, schema, with_row_key, written
from tessella.llm.components import connected_components
from tessella.llm.golomb import golomb_decode, golomb_encode
from tessella.llm.simhash import _hashes, hamming_links, simhash

#: Bits of a node's number that are the row's position in its file.
NODE_BITS = 40
#: Bits of a shingle's hash that owners compare. Two that agree in them by chance only keep a document in the race.
FP_BITS = 44
#: Shingles that a sender holds before it sends, and that an owner compares, about.
SENT, OWNED = 500_000, 4_000_000


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the text's shingles; a text without words has one of its own."""
    return np.unique(np.array(_hashes(text or b"", shingle) or [0], np.uint64))


def _send(shingle: int, owners: int):
    """Documents with the places of their shingles in the sender's list, and the list's parts, one for each owner."""
    span = -(-(1 << FP_BITS) // owners)

    def flush(sender: int, nodes: list, sets: list):
        size = np.array([len(x) for x in sets])
        distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
        again = np.bincount(place, minlength=len(distinct)) > 1
        own = [np.sort(x) for x in np.split(place, np.cumsum(size)[:-1])]
        packed = []
        for x in own:
            gaps = np.diff(x, prepend=0)
            packed.append(gaps.astype(np.uint16 if gaps.max() < 1 << 16 else np.uint32).tobytes())
        n = len(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, sender)), pa.array(nodes, pa.int64()), pa.array(size, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64())], names)
        to, first = np.unique(distinct // span, return_index=True)
        parts = [golomb_encode(x - o * span, span) for o, x in zip(to, np.split(distinct, first[1:]), strict=True)]
        m = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, sender)), pa.nulls(m, pa.int64()), pa.array(first, pa.int64()), pa.array(parts, pa.binary()), pa.array(to, pa.int64())], names)
        # what the sender itself has more than once, told as an answer to itself
        yield pa.RecordBatch.from_arrays([pa.array([sender]), pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([np.packbits(again).tobytes()], pa.binary()), pa.array([-1], pa.int64())], names)

    names = ["sender", "node", "n", "data", "owner"]

    def run(batches):
        sender, nodes, sets, held = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            for node, t in zip(b.column("node").to_pylist(), b.column("_text").cast(pa.binary()).to_pylist(), strict=True):
                x = (shingles(t, shingle) >> np.uint64(64 - FP_BITS)).view(np.int64)
                nodes.append(node)
                sets.append(x)
                held += len(x)
                if held >= SENT:
                    yield from flush(sender, nodes, sets)
                    sender, nodes, sets, held = sender + 1, [], [], 0
        if nodes:
            yield from flush(sender, nodes, sets)
        nodes, sets = [], []
        release()

    return run


def _answer(t: pa.Table) -> pa.Table:
    """For each list that an owner got, a bitmap of what other lists have as well."""
    lists = [golomb_decode(x) for x in t.column("data").to_pylist()]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    maps = []
    for x in lists:
        at = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
        maps.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
    return pa.table({"to": t.column("sender"), "first": t.column("n"), "bits": pa.array(maps, pa.binary())})


def _in_race(least: Fraction):
    """Documents of a sender that share enough shingles with any others to be similar to one."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        firsts, maps = answers.column("first").to_pylist(), answers.column("bits").to_pylist()
        shared = np.zeros(max((f + 8 * len(m) for f, m in zip(firsts, maps, strict=True)), default=0) + 8, bool)
        for f, m in zip(firsts, maps, strict=True):
            bits = np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool)
            shared[f : f + len(bits)] |= bits  # padding bits are zero
        good = []
        for n, data in zip(docs.column("n").to_pylist(), docs.column("data").to_pylist(), strict=True):
            at = np.cumsum(np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64))
            good.append(int(shared[at].sum()) * least.denominator >= least.numerator * n)
        return pa.table({"node": docs.column("node")}).filter(pa.array(good, pa.bool_()))

    return run


def racing(rows: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Nodes of rows(node, _text) that may have a similar one: a similar set holds at least `least` of a set's shingles."""
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // 6 // OWNED)
    table = written(rows.select("node", "_text").mapInArrow(_send(shingle, owners), "sender bigint, node bigint, n bigint, data binary, owner bigint"), "lists")
    lists = table.where("owner >= 0").select("sender", "owner", "n", "data")
    answers = lists.groupBy("owner").applyInArrow(_answer, "to bigint, first bigint, bits binary")
    mine = table.where("owner = -1").select(F.col("sender").alias("to"), F.col("n").alias("first"), F.col("data").alias("bits"))
    docs = table.where("owner IS NULL").select("sender", "node", "n", "data")
    return docs.groupBy("sender").cogroup(answers.union(mine).groupBy("to")).applyInArrow(_in_race(least), "node bigint")


def _sets(rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, fp (SimHash), n and the sorted hashes of the shingle set, of the nodes asked for."""

    def run(batches):
        for b in batches:
            texts = b.column("_text").cast(pa.binary()).to_pylist()
            sets = [shingles(t, shingle) for t in texts]
            fp = pa.array(simhash(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), fp, pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "fp", "n", "hashes"]
            )
            del texts, sets
        release()

    few = rows.where(maybe_in(F.xxhash64("node"), nodes.select(F.xxhash64("node").alias("x")), "x")).select("node", "_text")
    return written(few.join(nodes, "node", "left_semi").mapInArrow(run, "node bigint, fp bigint, n int, hashes binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Those of pairs(a, b) whose shingle sets have the similarity."""
    pairs = written(pairs.select("a", "b"), "suspects")
    if not pairs.head(1):
        return pairs
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                good = []
                for s, t in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                    short, long = sorted((len(s) // 8, len(t) // 8))
                    shared = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True)) if short * least.denominator >= long * least.numerator else 0
                    good.append(shared * least.denominator >= (short + long - shared) * least.numerator)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        release()

    return written(both.mapInArrow(run, "a bigint, b bigint"), "confirmed")


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with comp, the component of the links that each is in."""
    roots = written(connected_components(links), "components").toDF("_node", "_root")
    return nodes.join(roots, F.col("node") == F.col("_node"), "left").withColumn("comp", F.coalesce("_root", F.xxhash64("node"))).drop("_node", "_root")


def _prefixes(sets: DataFrame, least: Fraction) -> DataFrame:
    """(node, n, common, h, slack): the first shingles of each set, rarest first, that others have as well.

    All of them by exact counts; `common` is the mean count of the set's shingles. Sets of a and b shingles are similar if
    they share p / (p + q) of a + b, the similarity being p / q. So the first one that they share, and what comes after it
    in either set, is at least that many; of a set's m last shingles (p + q) m - p n is what this leaves for p times the
    other's n, the slack.
    """
    p, q = least.numerator, least.denominator

    def spread(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                hashes = [np.frombuffer(x, np.int64) for x in part.column("hashes").to_pylist()]
                if hashes:
                    size = part.column("n").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(hashes))], ["node", "n", "h"])

    parts = sets.select("node", F.col("n").cast("long").alias("n"), "hashes").mapInArrow(spread, "node bigint, n bigint, h bigint")
    # every set is counted, but for hashes that only one set has: those come first in their sets and tell nothing
    counts = written(parts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    shared = parts.join(counts, "h").groupBy("node", "n").agg(F.sum("c").alias("sum"), F.array_sort(F.collect_list(F.struct("c", "h"))).alias("all"))  # of one set
    common = ((F.col("sum") + F.col("n") - F.size("all")) / F.col("n")).alias("common")
    each = shared.select("node", "n", common, F.size("all").alias("m"), F.posexplode("all").alias("i", "x")).withColumn("last", F.col("m") - F.col("i"))
    return written(each.where(F.col("last") * q >= F.col("n") * p).select("node", "n", "common", "x.h", (F.col("last") * (p + q) - F.col("n") * p).alias("slack")), "prefixes")


def _apart(parts: DataFrame) -> DataFrame:
    """Rows of parts(comp, h, ...) whose shingle is in more than one component: others have nothing to tell."""
    mixed = written(parts.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h"), "mixed")
    return written(parts.join(mixed, "h", "left_semi"), "parts")


def _alike(an: str, bn: str, least: Fraction) -> Column:
    return (F.col(an) * least.denominator >= F.col(bn) * least.numerator) & (F.col(bn) * least.denominator >= F.col(an) * least.numerator)


def _size_class(n: str) -> str:
    """Four classes between a power of two and the next, which grow with n."""
    return f"4 * length(bin({n})) + (shiftright(shiftleft({n}, 3), length(bin({n}))) & 3)"


def _met(parts: DataFrame, least: Fraction) -> DataFrame:
    """Pairs(a, b) of parts(node, comp, n, h, slack) of two components whose first common shingle may be h.

    The slack of either covers p times the other's size; so the smaller set's covers its own, and only such rows are on
    the small side. Rows meet within classes of sizes. What no row of the other side in the bucket can meet, as its best
    values tell, goes before the join: members of one component, and those of which too little comes after the shingle,
    are not paired, however large the bucket is.
    """
    p, q = least.numerator, least.denominator
    low = f"(n * {p}L + {q - 1}L) div {q}L"
    small = parts.where(F.col("slack") >= F.col("n") * p).select("h", F.expr(_size_class("n")).alias("size"), "node", "comp", "n", "slack")
    large = parts.select("h", F.explode(F.sequence(F.expr(_size_class(low)), F.expr(_size_class("n")))).alias("size"), "node", "comp", "n", "slack")

    def able(rows: DataFrame, others: DataFrame) -> DataFrame:
        best = others.groupBy("h", "size").agg(F.min("n").alias("_n"), F.max("slack").alias("_slack"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
        can = (F.col("slack") >= F.col("_n") * p) & (F.col("_slack") >= F.col("n") * p) & ((F.col("comp") != F.col("_lo")) | (F.col("comp") != F.col("_hi")))
        return written(rows.join(best, ["h", "size"]).where(can).drop("_n", "_slack", "_lo", "_hi"), "able")

    large = able(large, small)
    small = able(small, large)
    large = able(large, small)
    a, b = (x.toDF("h", "size", *[k + c for c in x.columns[2:]]) for k, x in (("a", large), ("b", small)))
    once = (F.col("bn") < F.col("an")) | ((F.col("bn") == F.col("an")) & (F.col("bnode") < F.col("anode")))
    fits = (F.col("aslack") >= F.col("bn") * p) & (F.col("bslack") >= F.col("an") * p)
    return a.join(b, ["h", "size"]).where(once & fits & (F.col("acomp") != F.col("bcomp"))).select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, shingle: int = 5, similarity: float = 0.8, stars: int = 3) -> DataFrame:
    """One row per document: id, the carried columns, component.

    Words and hashes are those of simhash_dedup. Texts are linked where the Jaccard similarity of their sets of shingles
    of `shingle` words is at least `similarity`; `component` tells the groups that links connect apart. Texts without
    words, null ones too, are all alike. No pair is lost: links of SimHash and of stars, confirmed, only save the last
    join the pairs within one group. Repeated rows are told one by one; an empty table gives no rows.
    """
    least = Fraction(str(similarity))
    carry = carry or []
    keyed = with_row_key(docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate([id_col, *carry])], F.col(text_col).cast("string").alias("_text")), "_key")
    files = sorted(r[0] for r in keyed.select("_key.file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), schema(("_no", T.LongType()), ("_file", T.LongType())))
    rows = keyed.join(F.broadcast(numbers), F.col("_key.file") == F.col("_file")).withColumn("node", F.shiftleft("_no", NODE_BITS).bitwiseOR(F.col("_key.pos"))).drop("_key", "_no", "_file")
    sets = _sets(rows, written(racing(rows, shingle, least), "racing"), shingle)
    # stars of equal fingerprints, and the links of those that differ in few bits
    prints = written(sets.groupBy("fp").agg(F.min("node").alias("head")), "prints")
    same = sets.select("node", "fp").join(prints.toDF("_fp", "head"), F.col("fp") == F.col("_fp")).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = written(hamming_links(prints.select("fp")), "links").toDF("x", "y")
    across = links.join(prints.toDF("x", "a"), "x").join(prints.toDF("y", "b"), "y").select("a", "b")
    close = _confirmed(same.union(across), sets, least)
    prefixes = _prefixes(sets, least)
    parts = _apart(_named(prefixes, close))
    for turn in range(stars):
        # in each bucket one node is compared with all that are not of its component: first the one whose shingles are the
        # most common, as the text is that a group's members were made from, then one drawn by hash
        order = F.struct(-F.col("common") if turn == 0 else F.lit(0.0), F.xxhash64("comp", "node", F.lit(turn)))
        chosen = parts.groupBy("h").agg(F.min_by(F.struct(F.col("node").alias("a"), F.col("comp").alias("ac"), F.col("n").alias("an")), order).alias("s")).select("h", "s.*")
        met = parts.join(chosen, "h").where((F.col("comp") != F.col("ac")) & _alike("n", "an", least)).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        found = _confirmed(met, sets, least)
        if not found.head(1):
            break
        close = close.union(found)
        parts = _apart(_named(parts.drop("comp"), close))
    far = _confirmed(_met(parts, least), sets, least)
    told = written(_named(sets.select("node"), close.union(far)).select(F.col("node").alias("_node"), "comp"), "groups")
    names = [F.col(f"_c{i}").alias(c) for i, c in enumerate([id_col, *carry])]
    return rows.drop("_text").join(told, F.col("node") == F.col("_node"), "left").select(*names, F.coalesce("comp", F.xxhash64("node")).alias("component"))
