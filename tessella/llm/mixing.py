"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

The words of a source lie on a line, document after document in pseudo-random order, and are cut into blocks. A
source's quota is a number of block draws: whole passes over all its blocks, and a last pass over some of them. A binary
tree splits the quotas of all sources at once between its halves, by multivariate hypergeometric draws, down to the
output shards. The shards share each pass's permuted blocks out between them: a whole pass in runs as long as what the
quotas leave for it, the last pass in runs proportional to what each shard still has to draw; a shard draws the first
ones of its run. So shards are disjoint, the tree decides which blocks the last pass takes, and a document's taken words
are the sum of what shards drew of it. Within a shard pieces are ordered by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import bounded_broadcast, line_up, n_words, written

#: Multipliers of the block permutation; a line of blocks that is a multiple of both would have 10^12 blocks.
PRIMES = (1_000_003, 999_983)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, target of sizes(source, source_size): shares of the whole by weight, at most `most` times the size.

    Sources by code point, null last, have the weights in turn. What a source may not take is reshared by weight, until
    none is above its limit: the level at which that ends is found from running sums over the sources by limit per
    weight. The window over all sources has one row a source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    leveled = limited.withColumn("k", F.row_number().over(by)).withColumn("level", level)
    stop = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("limit") * (1 + 1e-12), F.col("k"))).over(every)
    return leveled.withColumn("target", F.least("limit", F.col("weight") * stop)).select("source", "source_size", "target", "rank")


def _uniform(*parts: str) -> str:
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / {float(1 << 53)!r}D)"


def _ln_factorials(values: list[str]) -> str:
    """Sum of ln(v!) by Stirling's series eight steps up."""
    y = "(v + 8D)"
    down = " * ".join(f"(v + {i}D)" for i in range(1, 9))
    series = f"{y} * ln({y}) - {y} + 0.5D * ln({2 * math.pi!r}D * {y}) + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) + 1D / (1260D * pow({y}, 5))"
    return f"aggregate(array({', '.join(f'cast({v} AS double)' for v in values)}), 0D, (t, v) -> t + {series} - ln({down}))"


def _hypergeometric(good: str, pop: str, draws: str, seed: list[str]) -> str:
    """SQL for the number of good ones among `draws` of `pop`, by ratio of uniforms with rejection.

    Each try is accepted with probability above 0.7. 256 refused ones in a row, which never happen, are an error.
    """
    few, m = f"least({good}, {pop} - {good})", f"least({draws}, {pop} - {draws})"
    setup = (
        f"named_struct('s', cast({few} AS double), 'm', cast({m} AS double), 'p', cast({pop} AS double), "
        f"'mid', {m} * ({few} / {pop}) + 0.5D, "
        f"'sd', sqrt(({pop} - {m}) * cast({m} AS double) * ({few} / {pop}) * (1 - {few} / {pop}) / ({pop} - 1) + 0.5D), "
        f"'mode', floor(({m} + 1D) * ({few} + 1D) / ({pop} + 2D)))"
    )
    facts = lambda z: _ln_factorials([z, f"q.s - {z}", f"q.m - {z}", f"q.p - q.s - q.m + {z}"])
    w = f"(q.mid + (1.7155277699214135D * q.sd + 0.8989161620588988D) * ({_uniform(*seed, 'i', '2')} - 0.5D) / {_uniform(*seed, 'i', '1')})"
    fits = f"w >= 0 AND w < least(least(q.m, q.s) + 1, floor(q.mid + 16 * q.sd)) AND 2 * ln({_uniform(*seed, 'i', '1')}) <= {facts('q.mode')} - {facts('floor(w)')}"
    one = f"element_at(transform(array({w}), w -> IF({fits}, cast(floor(w) AS bigint), NULL)), 1)"
    tried = f"coalesce(aggregate(sequence(1, 256), cast(NULL AS bigint), (z, i) -> coalesce(z, {one})), cast(raise_error('no hypergeometric draw was accepted') AS bigint))"
    few_drawn = f"element_at(transform(array({setup}), q -> {tried}), 1)"
    mirrored = f"IF({good} > {pop} - {good}, {m} - {few_drawn}, {few_drawn})"
    both = f"IF({m} < {draws}, {good} - {mirrored}, {mirrored})"
    return f"CASE WHEN {good} <= 0 OR {draws} <= 0 THEN 0L WHEN {draws} >= {pop} THEN {good} WHEN {good} >= {pop} THEN {draws} ELSE {both} END"


def _halved(nodes: DataFrame, seed: int) -> DataFrame:
    """nodes(node, part, have, left) with lefts: how many of each entry of `have` go left, `left` in all.

    The law is multivariate hypergeometric, drawn entry by entry from what is left of both.
    """
    drawn = _hypergeometric("c", "s.pop", "s.left", [str(seed), "node", "part", "size(s.out)"])
    step = f"(s, c) -> element_at(transform(array({drawn}), x -> named_struct('pop', s.pop - c, 'left', s.left - x, 'out', concat(s.out, array(x)))), 1)"
    start = "named_struct('pop', aggregate(have, 0L, (t, c) -> t + c), 'left', left, 'out', cast(array() AS array<bigint>))"
    return nodes.withColumn("lefts", F.expr(f"aggregate(have, {start}, {step}).out"))


def splitting_tree(quotas: DataFrame, depth: int, seed: int, width: int = 1000) -> DataFrame:
    """(rank, shard, draws > 0) for quotas(rank, draws): the leaves of a tree of `depth` levels.

    A node's left half gets half of the node's draws, rounded up; how many of each source follows a multivariate
    hypergeometric law. Rows of the tree are (node, part), where a part is `width` sources: the node's draws are first
    split between its parts and then within each, which is the same law, and no row holds all sources.
    """
    part = F.floor(F.col("rank") / width).cast("long")
    array = F.expr("transform(array_sort(collect_list(struct(rank, draws))), x -> x.draws)")
    level = quotas.groupBy(part.alias("part")).agg(array.alias("have")).withColumn("node", F.lit(1).cast("long"))
    for _ in range(depth):
        sums = level.select("node", "part", F.expr("aggregate(have, 0L, (t, c) -> t + c)").alias("total"))
        whole = sums.groupBy("node").agg(F.expr("array_sort(collect_list(struct(part, total)))").alias("parts"))
        whole = whole.select("node", F.lit(-1).cast("long").alias("part"), F.col("parts.part").alias("of"), F.col("parts.total").alias("have"))
        whole = whole.withColumn("left", F.expr("cast(ceil(aggregate(have, 0L, (t, c) -> t + c) / 2) AS bigint)"))
        shares = _halved(whole, seed).select(F.col("node").alias("_n"), F.explode(F.arrays_zip("of", "lefts")).alias("x")).select("_n", F.col("x.of").alias("_p"), F.col("x.lefts").alias("left"))
        split = _halved(level.join(shares, (F.col("node") == F.col("_n")) & (F.col("part") == F.col("_p"))).drop("_n", "_p"), seed)
        rest = F.zip_with("have", "lefts", lambda h, x: h - x)
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("lefts").alias("have")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("have")))
        level = written(split.select("part", F.explode(children).alias("x")).select("part", "x.node", "x.have"), "tree")
    leaves = level.select("part", (F.col("node") - (1 << depth)).alias("shard"), F.posexplode("have").alias("at", "draws"))
    return leaves.where("draws > 0").select((F.col("part") * width + F.col("at")).alias("rank"), "shard", "draws")


def shard_runs(leaves: DataFrame, plan: DataFrame) -> DataFrame:
    """(rank, shard, begin, end, drawn): runs of a source's permuted blocks, over all passes, and how many of each the shard draws.

    Places count on from pass to pass: pass e has the places from e x blocks on. In whole passes all of a run is drawn;
    of the last pass a shard has a run in proportion to what it draws there, and draws the first of it.
    """
    ahead = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    of = leaves.join(plan.select(F.col("rank").alias("_rank"), "blocks", "passes", "few"), F.col("rank") == F.col("_rank"))
    placed = of.withColumn("q0", F.coalesce(F.sum("draws").over(ahead), F.lit(0))).withColumn("q1", F.col("q0") + F.col("draws")).withColumn("full", F.col("passes") * F.col("blocks"))
    f0, f1 = F.greatest(F.col("q0") - F.col("full"), F.lit(0)), F.greatest(F.col("q1") - F.col("full"), F.lit(0))
    share = lambda f: F.col("full") + F.expr(f"IF(few > 0, cast(blocks AS decimal(19, 0)) * cast({f} AS decimal(19, 0)) div few, 0L)")
    runs = F.array(
        F.struct(F.col("q0").alias("begin"), F.least("q1", "full").alias("end"), (F.least("q1", "full") - F.col("q0")).alias("drawn")),
        F.struct(share("f0").alias("begin"), share("f1").alias("end"), (F.col("f1") - F.col("f0")).alias("drawn")),
    )
    return placed.withColumn("f0", f0).withColumn("f1", f1).select("rank", "shard", F.explode(runs).alias("x")).select("rank", "shard", "x.*").where("drawn > 0")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block_words: int = 1024, shard_blocks: int = 1 << 15, seed: int = 42) -> DataFrame:
    """One row per document: id, the carried columns, size, source_size, target, pieces, taken.

    pieces: an array of (pass, first, words, shard) in order of pass and first word, what the shards drew of the
    document; taken is the sum of their words, at most `most` times the size. Each source's taken words are its target,
    rounded to a word. A null source is a source of its own, the last; a null or empty text has size 0 and no pieces.
    Order on the line is by hash of id, text and seed, so reruns agree; equal rows are interchangeable. An empty table
    gives no rows; other columns of docs do not matter.

    A line's last block has up to twice block_words; it comes first in each permutation, so that it is always drawn in a
    last pass, of which it makes the words come out even.
    """
    carry = carry or []
    held = [f"_c{i}" for i in range(len(carry) + 1)]
    text = F.col(text_col).cast("string")
    plain = docs.select(
        *[F.col(f"`{c}`").alias(h) for c, h in zip([id_col, *carry], held, strict=True)], F.col(source_col).cast("string").alias("source"),
        n_words(text).alias("size"), F.xxhash64(F.col(id_col).cast("string"), text, F.lit(seed)).alias("_order"), F.monotonically_increasing_id().alias("_k"),
    )
    sized = written(plain, "sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    b, z = F.lit(block_words), F.col("source_size")
    plan = (
        source_targets(stats, weights, most)
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("blocks", F.when(z > 0, F.greatest(F.floor(z / b), F.lit(1))).otherwise(0).cast("long"))
        .withColumn("passes", F.when(z > 0, F.floor(F.col("words") / z)).otherwise(0).cast("long"))
        .withColumn("rest", F.col("words") - F.col("passes") * z)
        .withColumn("few", F.least(F.ceil(F.col("rest") / b).cast("long"), F.col("blocks")))
        .withColumn("even", F.col("rest") - F.greatest(F.col("few") - 1, F.lit(0)) * b)  # words of the last block in the last pass
        .withColumn("factor", F.when(F.col("blocks") % PRIMES[0] != 0, PRIMES[0]).otherwise(PRIMES[1]).cast("long"))
        .withColumn("draws", F.col("passes") * F.col("blocks") + F.col("few"))
    )
    plan = written(plan.withColumn("rank", F.col("rank").cast("long")), "plan")
    draws = plan.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    depth = max(1, math.ceil(math.log2(max(1, draws / shard_blocks))))
    runs = shard_runs(splitting_tree(plan.select("rank", "draws"), depth, seed), plan)
    # runs by bins of places, so that a block finds its run by an equal key; a source has about as many bins as shards
    wide = F.greatest(F.lit(1), F.ceil((F.col("passes") + 1) * F.col("blocks") / (1 << depth))).cast("long")
    known = written(plan.withColumn("wide", wide), "sources")
    runs = runs.join(known.select(F.col("rank").alias("_rank"), "wide"), F.col("rank") == F.col("_rank"))
    runs = runs.select(F.col("rank").alias("_rank"), F.explode(F.sequence(F.expr("begin div wide"), F.expr("(end - 1) div wide"))).alias("_bin"), "shard", "begin", "end", "drawn")
    runs = bounded_broadcast(written(runs, "runs"), 100_000)  # seven numbers a row
    lined = written(line_up(sized, "source", "size", F.col("_order")).drop("_order"), "lined")
    sources = bounded_broadcast(known.withColumnRenamed("source", "_source").drop("draws", "words"), 100_000)
    told = lined.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    inside = f"sequence(least(line_start div {block_words}, blocks - 1), least((line_start + size - 1) div {block_words}, blocks - 1))"
    parts = told.where("size > 0").select("_k", "line_start", "size", "rank", "source_size", "blocks", "passes", "even", "factor", "wide", F.explode(F.expr(inside)).alias("b"), F.expr("sequence(0L, passes)").alias("e"))
    parts = parts.withColumn("e", F.explode("e")).withColumn("place", F.expr("e * blocks + pmod(factor * (b + 1), blocks)"))  # the last block has the first place of a pass
    met = parts.join(runs, (F.col("rank") == F.col("_rank")) & (F.expr("place div wide") == F.col("_bin")) & (F.col("place") >= F.col("begin")) & (F.col("place") < F.col("begin") + F.col("drawn")))
    stop = f"CASE WHEN b < blocks - 1 THEN (b + 1) * {block_words}L WHEN e < passes THEN source_size ELSE b * {block_words}L + even END"
    first, end = F.expr(f"greatest(line_start, b * {block_words}L)"), F.expr(f"least(line_start + size, {stop})")
    pieces = met.select("_k", F.col("e").alias("pass"), (first - F.col("line_start")).alias("first"), (end - first).alias("words"), "shard").where("words > 0")
    drawn = pieces.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("pass", "first", "words", "shard"))).alias("pieces")).withColumnRenamed("_k", "_of")  # of one document
    empty = F.expr("cast(array() AS array<struct<pass: bigint, first: bigint, words: bigint, shard: bigint>>)")
    return (
        told.select(*held, "_k", "size", "source_size", "target").join(drawn, F.col("_k") == F.col("_of"), "left").withColumn("pieces", F.coalesce("pieces", empty))
        .withColumn("taken", F.expr("aggregate(pieces, 0L, (t, p) -> t + p.words)"))
        .select(*[F.col(h).alias(c) for c, h in zip([id_col, *carry], held, strict=True)], "size", "source_size", "target", "pieces", "taken")
    )


def mixed_documents(docs: DataFrame, mixed: DataFrame, key: str, text_col: str = "text", seed: int = 42) -> DataFrame:
    """docs once for each pass in which the shards drew words of them, with the words of that pass as text, shard by shard.

    mixed: the mix of docs by the unique column `key`. A document is a row of the shard that drew its first words of the
    pass, so that it stays whole where blocks of two shards meet in it; a shard's rows come in an order by hash, and are
    written in 64 slices of that order, so that no task holds a shard. A document taken whole keeps its text as it is; of
    others the words drawn keep the white space before them. Documents of which nothing was drawn, empty ones too, give no
    row. Other columns, whatever their names, are carried along.
    """
    held = [f"c{i}" for i in range(len(docs.columns))]
    k, text = held[docs.columns.index(key)], F.col(held[docs.columns.index(text_col)])
    taken = mixed.select(F.col(key).alias("_key"), F.col("size").alias("_size"), F.explode(F.expr("transform(array_distinct(pieces.pass), e -> filter(pieces, p -> p.pass = e))")).alias("_pieces"))
    rows = docs.toDF(*held).join(taken, F.col(k) == F.col("_key"))
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    cut = F.array_join(F.flatten(F.transform("_pieces", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")
    whole = F.aggregate("_pieces", F.lit(0).cast("long"), lambda t, p: t + p["words"]) == F.col("_size")
    pass_, shard = F.col("_pieces")[0]["pass"], F.col("_pieces")[0]["shard"]
    rows = rows.withColumns({"_shard": shard, "_order": F.xxhash64(F.lit(seed), pass_, "_key")})
    slice_ = F.shiftrightunsigned("_order", 58)
    rows = rows.withColumn("_slice", slice_).repartition("_shard", "_slice").sortWithinPartitions("_shard", "_slice", "_order")
    return rows.select(*[F.when(whole, text).otherwise(cut).alias(text_col) if h == held[docs.columns.index(text_col)] else F.col(h).alias(c) for h, c in zip(held, docs.columns, strict=True)])


def shards(mixed: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """The pieces of a mix by shard, each shard in its own pseudo-random order: shard, id, pass, first, words.

    An empty mix gives no rows; repeated or null ids are so many rows.
    """
    rows = mixed.select(id_col, F.explode("pieces").alias("p")).select("p.shard", id_col, "p.pass", "p.first", "p.words")
    order: Column = F.xxhash64(F.lit(seed), *[F.col(c) for c in (id_col, "pass", "first")])
    return rows.repartition("shard").sortWithinPartitions("shard", order, id_col, "pass", "first")
