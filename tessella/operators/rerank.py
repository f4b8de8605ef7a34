"""Order-dependent reranking of a query's first hits: diversity, neighbour lifts, vector mixing, topic groups.

Each step walks down at most `POOL` hits of one query, so it runs as a grouped function with one small frame a query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

POOL, LAMBDA, FLOOR = 50, 0.7, 0.35
HOP, HOP_MOST, CAP = 0.25, 2, 1.5
TOPIC = 0.4


def alike(a: dict, b: dict) -> float:
    """0.5 of the tags' Jaccard, 0.3 of the title words', 0.2 for one scope."""

    def jaccard(x: set, y: set) -> float:
        return len(x & y) / len(x | y) if x | y else 0.0

    words = [set(str(r["title"]).lower().split()) for r in (a, b)]
    return 0.5 * jaccard(set(a["tags"]), set(b["tags"])) + 0.3 * jaccard(*words) + (0.2 if a["scope"] and a["scope"] == b["scope"] else 0.0)


def _ordered(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (-r["score"], -r["created"].toordinal(), r["id"]))


def diversify(rows: list[dict]) -> list[dict]:
    """Scores of hits that are like one above them shrink by up to 3/7 of the likeness; the first stays."""
    pool, rest = rows[:POOL], rows[POOL:]
    for i, r in enumerate(pool[1:], 1):
        worst = max(alike(r, b) for b in pool[:i])
        if worst >= FLOOR:
            r["score"] *= 1 - (1 - LAMBDA) / LAMBDA * worst
    return _ordered(pool) + rest


def hop(rows: list[dict], joined: set[tuple]) -> list[dict]:
    """Hits linked with better ones rise by a quarter of bonus for each of at most two, within the cap and below the best neighbour."""
    pool, rest = rows[:POOL], rows[POOL:]
    for i, r in enumerate(pool[1:], 1):
        near = [b for b in pool[:i] if (r["id"], b["id"]) in joined or (b["id"], r["id"]) in joined]
        want = min(CAP, r["bonus"] + HOP * min(len(near), HOP_MOST))
        if near and want > r["bonus"] > 0:
            lifted = min(r["score"] * want / r["bonus"], near[0]["score"])
            if lifted > r["score"]:
                r["score"], r["bonus"] = lifted, want
    return _ordered(pool) + rest


def groups(rows: list[dict]) -> list[dict]:
    """Numbers of topic groups by first appearance; 0 for hits alone."""
    number = [0] * len(rows)
    same = lambda a, b: len(set(a["tags"]) & set(b["tags"])) >= 2 or alike(a, b) >= TOPIC
    last = 0
    for i, r in enumerate(rows):
        number[i] = next((number[k] for k in range(i) if number[k] and same(r, rows[k])), 0)
        if not number[i] and any(same(r, b) for b in rows[i + 1 :]):
            last += 1
            number[i] = last
    sizes = {g: number.count(g) for g in number if g}
    order: dict[int, int] = {}
    for i, g in enumerate(number):
        rows[i]["topic"] = order.setdefault(g, len(order) + 1) if sizes.get(g, 0) > 1 else 0
    return rows


def rerank(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits(query, id, title, tags, scope, created, bonus, score) diversified, lifted and grouped: (query, place, id, score, topic).

    Only edges with both ends among a query's hits reach its function.
    """
    mine = hits.select("query", "id")
    inside = edges.join(mine.withColumnRenamed("id", "src"), "src").join(mine.withColumnRenamed("id", "dst"), ["query", "dst"]).select("query", "src", "dst").distinct().toDF("of", "src", "dst")

    def run(h: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(h.to_dict("records"))
        rows = groups(hop(diversify(rows), set(zip(e["src"], e["dst"], strict=True))))
        return pd.DataFrame({"query": [r["query"] for r in rows], "place": range(1, len(rows) + 1), "id": [r["id"] for r in rows], "score": [round(r["score"], 9) for r in rows], "topic": [r["topic"] for r in rows]})

    kind = dict(hits.dtypes)
    return hits.groupBy("query").cogroup(inside.groupBy("of")).applyInPandas(run, f"query {kind['query']}, place int, id {kind['id']}, score double, topic int")


def mix(words: list[tuple], meanings: list[tuple], softener: float = 10.0, weight: float = 1.0, floor: float = 0.58, ceiling: int = 3, gap: float = 0.0, keep: int = 1) -> list[tuple]:
    """(id, share) of word hits [(id,)] in order fused with vector picks [(id, cos)] in order.

    A hit has the larger of 1 / (k + its word place) and w / (k + its vector place), if the pick is near and high
    enough; picks by meaning alone must stand out of the median by `gap`. The first `keep` word hits never fall below
    their places.
    """
    place = {i: (p, c) for p, (i, c) in enumerate(meanings, 1)}
    cosines = sorted(c for _, c in meanings)
    middle = (cosines[(len(cosines) - 1) // 2] + cosines[len(cosines) // 2]) / 2 if cosines else 0.0
    good = lambda i: i in place and place[i][1] >= floor and place[i][0] <= ceiling
    fused = [(max(1 / (softener + at), weight / (softener + place[i][0]) if good(i) else 0.0), at, i) for at, (i,) in enumerate(words, 1)]
    known = {i for (i,) in words}
    fused += [(weight / (softener + p), len(words) + p, i) for i, (p, c) in place.items() if i not in known and good(i) and (gap <= 0 or c - middle >= gap)]
    fused.sort(key=lambda x: (-x[0], x[1]))
    for at in range(1, keep + 1):
        now = next((k for k, x in enumerate(fused) if x[1] == at), None)
        if now is not None and now >= at:
            fused.insert(at - 1, fused.pop(now))
    return [(i, share) for share, _, i in fused]
