"""Groups of notes that make up a card: chains, link components, meaning clusters; plans against the cards that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import vectors as V
from tessella.operators import graph as G
from tessella.storage import checkpointed

#: Members of a group at least and at most, of a meaning cluster at most, floors of its cosine, likeness of group and card.
LEAST, MOST, CLUSTER, FLOORS, SAME = 3, 12, 8, (0.80, 0.84, 0.88, 0.92, 0.96), 0.5


def link_groups(notes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """(group, id): components over edges between live notes of one scope, of 3 to 12 members; the group is its smallest id."""
    live = notes.where(P.is_live(as_of) & (F.col("type") != "observation")).select("id", "scope")
    end = lambda c: live.select(F.col("id").alias(c), F.col("scope").alias(f"{c}_scope"))
    inside = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").where("src_scope = dst_scope AND src <> dst")
    members = G.components(inside.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("root").alias("group"), F.col("node").alias("id"))
    return sized(members, LEAST, MOST)


def sized(groups: DataFrame, least: int, most: int) -> DataFrame:
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= most)).select("group")
    return groups.join(sizes, "group", "left_semi")


def chain_groups(notes: DataFrame) -> DataFrame:
    """(group, id, hops): chains of supersession of two notes or more, with each note's hops to the end of its chain.

    A note knows its successor, so hops double along pointers: after n rounds 2^n steps are known. A cycle has no end; its
    notes get no hops.
    """
    own = notes.where("superseded_by IS NOT NULL").select(F.col("id").alias("node"), F.col("superseded_by").alias("to"))
    ends = own.select(F.col("to").alias("node")).join(own.select("node"), "node", "left_anti").distinct()
    at = own.select("node", "to", F.lit(1).alias("hops")).unionByName(ends.select("node", F.col("node").alias("to"), F.lit(0).alias("hops")))
    for _ in range(20):
        ahead = at.select(F.col("node").alias("x"), F.col("to").alias("y"), F.col("hops").alias("more"))
        at = at.join(ahead, F.col("to") == F.col("x"), "left").select("node", F.coalesce("y", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        at = checkpointed(at)
        if not at.join(ends.select(F.col("node").alias("e")), F.col("to") == F.col("e"), "left_anti").where(F.col("hops") < 1 << 20).head(1):
            break
    done = at.join(ends.select(F.col("node").alias("e")), F.col("to") == F.col("e"), "left_semi")
    return done.select(F.col("to").alias("group"), F.col("node").alias("id"), "hops")


def meaning_groups(notes: DataFrame, vectors: DataFrame, as_of: str, family: dict[str, str] | None = None) -> DataFrame:
    """(group, id): clusters of 3 to 8 live notes of one scope and family of types, by cosine; the group is its smallest id.

    Components at the lowest floor; those of more than eight members are cut again at the next higher one, up to the last,
    after which larger ones are dropped. Pairs are made within (scope, family) only. vectors(id, v).
    """
    kinds = F.create_map(*[F.lit(x) for k, v in (family or {}).items() for x in (k, v)]) if family else None
    group = F.coalesce(F.element_at(kinds, F.col("type")), F.col("type")) if family else F.col("type")
    live = notes.where(P.is_live(as_of) & (F.col("type") != "observation")).select("id", "scope", group.alias("family"))
    rows = live.join(vectors.select("id", V.unit(F.col("v")).alias("v")), "id")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.family") == F.col("b.family")) & (F.col("a.id") < F.col("b.id")))
    pairs = checkpointed(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), V.dot(F.col("a.v"), F.col("b.v")).alias("cos")).where(F.col("cos") >= FLOORS[0]))
    out, left = None, pairs
    for floor in FLOORS:
        found = G.components(left.where(F.col("cos") >= floor).select("a", "b")).select(F.col("root").alias("group"), F.col("node").alias("id"))
        good = sized(found, LEAST, CLUSTER)
        out = good if out is None else out.unionByName(good)
        large = checkpointed(sized(found, CLUSTER + 1, 1 << 30).select("id"))
        left = left.join(large.select(F.col("id").alias("a")), "a", "left_semi")
        if not large.head(1):
            break
    return out


def admitted(groups: DataFrame, notes: DataFrame, least: int = 2) -> DataFrame:
    """Groups without their automatic notes where they have fewer than `least` others."""
    rows = groups.join(notes.select("id", F.coalesce(F.col("origin") == "auto", F.lit(False)).alias("auto")), "id")
    human = F.sum((~F.col("auto")).cast("int")).over(Window.partitionBy("group"))
    return rows.withColumn("human", human).where(~F.col("auto") | (F.col("human") >= least)).select("group", "id")


def found(parts: list[DataFrame]) -> DataFrame:
    """(group, id) of several rules' groups, each set of members once: of equal sets the first rule's smallest group stays."""
    every = None
    for n, p in enumerate(parts):
        named = p.select(F.concat_ws(":", F.lit(n), F.col("group").cast("string")).alias("group"), "id")
        every = named if every is None else every.unionByName(named)
    sets = every.groupBy("group").agg(F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ",").alias("set"))  # of twelve at most
    first = sets.groupBy("set").agg(F.min("group").alias("group"))
    return every.join(first.select("group"), "group", "left_semi")


def plan(groups: DataFrame, cards: DataFrame) -> DataFrame:
    """(group, what, card): new, again (a card's members changed) or same, with each card matched to one group at most.

    A card is a group's if their members' Jaccard is a half or more, the most alike first; cards(card, basis array). Only
    pairs that share a member are compared, and matches are made within components of such pairs.
    """
    size = groups.groupBy("group").agg(F.count("*").alias("n"))
    base = cards.select("card", F.explode(F.array_distinct("basis")).alias("id"))
    count = base.groupBy("card").agg(F.count("*").alias("m"))
    met = groups.join(base, "id").groupBy("group", "card").agg(F.count("*").alias("both")).join(size, "group").join(count, "card")
    near = met.withColumn("like", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("like") >= SAME)
    # at a half or more a group has two cards at most, and a card two groups: ties at exactly a half; the best pair of both wins
    order = [F.desc("like"), "group", "card"]
    by_group, by_card = F.row_number().over(Window.partitionBy("group").orderBy(*order)), F.row_number().over(Window.partitionBy("card").orderBy(*order))
    matched = near.withColumn("g", by_group).withColumn("c", by_card).where("g = 1 AND c = 1").select(F.col("group").alias("_g"), "card", "like")
    told = size.join(matched, F.col("group") == F.col("_g"), "left")
    return told.select("group", F.when(F.col("card").isNull(), "new").when(F.col("like") == 1, "same").otherwise("again").alias("what"), "card")


def rewrite(plans: DataFrame, cards: DataFrame) -> DataFrame:
    """(card, body, tags, basis_hash, rev): what a card that is made again is patched with. plans(group, what, card), cards(group, body, tags, basis_hash, rev)."""
    return plans.where("what = 'again'").select("group", "card").join(cards, "group").select("card", "body", "tags", "basis_hash", (F.coalesce("rev", F.lit(0)) + 1).alias("rev"))

