"""Reports: hits within a budget, review queues as text and tables, the funnel of automatic notes, quotas, claims of a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X

#: Hits that one query renders, at most.
HITS = 100


def rendered(hits: DataFrame, budget: int, most: int = HITS) -> DataFrame:
    """(place, line) of hits(place, id, title, summary, score): one sanitised line each while the token budget lasts.

    The window is over a query's hits, a hundred at most. The first hit is always there, cut to the budget if need be.
    """
    line = F.concat(F.lit("- "), X.clip(X.neutralize(X.one_line(F.col("title"))), 60), F.lit(" ["), F.col("id").cast("string"), F.lit("] "), X.clip(X.neutralize(X.one_line(F.col("summary"))), 160))
    rows = hits.where(F.col("place") <= most).select("place", line.alias("line"))
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(X.token_estimate(F.col("line"))).over(order)
    kept = rows.withColumn("used", used).where((F.col("used") <= budget) | (F.col("place") == 1))
    return kept.select("place", F.when(F.col("used") <= budget, F.col("line")).otherwise(X.within_budget(F.col("line"), budget)).alias("line"))


def explained(hits: DataFrame) -> DataFrame:
    """(id, parts): what a hit's score is made of, as text."""
    two = lambda c: F.format_number(F.col(c), 3)
    return hits.select("id", F.concat_ws(" x ", F.concat(F.lit("rrf "), two("rrf")), F.concat(F.lit("bonus "), two("bonus")), F.concat(F.lit("decay "), two("decay")), F.concat(F.lit("trust "), two("trust"))).alias("parts"))


def byte_capped(lines: DataFrame, most: int) -> DataFrame:
    """Whole lines(place, line) of a block while their bytes, line ends counted, stay within the cap."""
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # of one block
    return lines.withColumn("bytes", F.sum(F.octet_length("line") + 1).over(order)).where(F.col("bytes") <= most)


def shrunk(blocks: DataFrame, budget: int, protected: list[str]) -> DataFrame:
    """(block, section, place, line): while a block's tokens exceed the budget, the longest unprotected section loses its last line.

    blocks(block, section, place, line). A block is a few dozen lines and is folded in one grouped function.
    """
    rows = blocks.withColumn("tokens", X.token_estimate(F.col("line")))
    kind = dict(blocks.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["section", "place"])
        while f["tokens"].sum() > budget:
            free = f[~f["section"].isin(protected)]
            if free.empty:
                break
            sums = free.groupby("section")["tokens"].sum()
            longest = sorted(sums[sums == sums.max()].index)[0]
            f = f.drop(free[free["section"] == longest].index[-1])
        return f[["block", "section", "place", "line"]]

    return rows.groupBy("block").applyInPandas(run, f"block {kind['block']}, section {kind['section']}, place {kind['place']}, line string")


def queue_table(items: DataFrame) -> DataFrame:
    """(scope, kind, notes): distinct notes of each scope and queue kind, and of all scopes as `*`. items(kind, scope, id)."""
    by_scope = items.groupBy("scope", "kind").agg(F.countDistinct("id").alias("notes"))
    every = items.groupBy("kind").agg(F.countDistinct("id").alias("notes")).select(F.lit("*").alias("scope"), "kind", "notes")
    return by_scope.unionByName(every)


def cross_table(items: DataFrame, kinds: list[str]) -> DataFrame:
    """A row a scope with a column a kind: distinct notes, 0 where there are none."""
    return items.groupBy("scope").pivot("kind", kinds).agg(F.countDistinct("id")).na.fill(0)


def queue_lines(items: DataFrame) -> DataFrame:
    """(line) kind, rule and ids of each queue entry by tabs, for machines."""
    return items.select(F.concat_ws("\t", "kind", "rule", F.col("id").cast("string"), F.array_join(F.coalesce("related", F.array().cast("array<string>")), ",")).alias("line"))


def review_text(items: DataFrame) -> DataFrame:
    """(kind, text) of kept entries(kind, place, rule, id, reason): a heading and a line each; a queue has twenty at most."""
    line = F.concat(F.lit("- `"), F.col("id").cast("string"), F.lit("` "), F.col("rule"), F.lit(" "), X.clip(X.neutralize(X.one_line(F.coalesce("reason", F.lit("")))), 200))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return items.groupBy("kind").agg(F.array_join(lines, "\n").alias("lines")).select("kind", F.concat(F.lit("## "), F.col("kind"), F.lit("\n"), F.col("lines")).alias("text"))


def allocate(total: int, shares: list[int], needs: list[int]) -> list[int]:
    """Places by per cent shares, none more than it needs; what is left over is handed out from front to back."""
    given = [min(n, total * s // 100) for s, n in zip(shares, needs, strict=True)]
    left = total - sum(given)
    for k, need in enumerate(needs):
        more = min(max(0, need - given[k]), max(0, left))
        given[k], left = given[k] + more, left - more
    return given


def funnel(events: DataFrame) -> DataFrame:
    """One row: nudges, adds, rejects and undos of automatic notes, and undo rate. events(kind, id)."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return events.agg(count("nudge").alias("nudges"), count("add").alias("adds"), count("reject").alias("rejects"), count("undo").alias("undos"), F.round(F.try_divide(count("undo"), count("add")), 9).alias("undo_rate"))


def outcomes(queue: DataFrame) -> DataFrame:
    """(result, n) of queue entries that are done, and `open` for the others."""
    return queue.groupBy(F.when(F.col("done_at").isNull(), "open").otherwise(F.coalesce("result", F.lit("unknown"))).alias("result")).agg(F.count("*").alias("n"))


_CLAIM_ADD = re.compile(r"""\badd\b[^\n]*?--summary\s+(?:"([^"]+)"|'([^']+)')""")
_CLAIM_LINE = re.compile(r"(?m)^\s*(?:[-*]\s*)?(?:정함|결정)\s*[:：]\s*(.+)$")
_TABLE_HEAD = re.compile(r"결정|정함|정한 것")


def claims(text: str) -> list[str]:
    """Decision sentences of a report: cells of the decision column of tables, lines that begin with a decision label, summaries of add commands."""
    found: list[str] = []
    lines = text.split("\n")
    cells = lambda x: [c.strip() for c in x.strip().strip("|").split("|")]
    for at, line in enumerate(lines[:-1]):
        if line.strip().startswith("|") and re.fullmatch(r"\s*\|[\s:|-]+\|\s*", lines[at + 1]):
            column = next((k for k, c in enumerate(cells(line)) if _TABLE_HEAD.search(c)), None)
            row = at + 2
            while column is not None and row < len(lines) and lines[row].strip().startswith("|"):
                c = cells(lines[row])
                found += [c[column]] if column < len(c) and c[column] else []
                row += 1
    found += [m.strip() for m in _CLAIM_LINE.findall(text)]
    found += [a or b for a, b in _CLAIM_ADD.findall(text)]
    return list(dict.fromkeys(f for f in found if f))


def cite_pairs(cards: DataFrame, notes: DataFrame) -> DataFrame:
    """(card, line_no, claim, id, evidence): each numbered line of a card against the notes it cites, for the judge. cards(id, body)."""
    lines = cards.select(F.col("id").alias("card"), F.posexplode(X.lines(F.col("body"))).alias("line_no", "line")).where(F.regexp_like("line", F.lit(r"^\s*\d+[.)]")))
    cited = lines.select("card", "line_no", F.regexp_replace(F.regexp_replace("line", r"^\s*\d+[.)]\s*", ""), r"\s*\[mem:[^\]]*\]", "").alias("claim"), F.explode(F.regexp_extract_all("line", F.lit(r"\[mem:([0-9A-Za-z-]+)\]"), F.lit(1))).alias("id"))
    return cited.join(notes.select(F.col("id").cast("string").alias("id"), F.concat_ws("\n", "title", "summary", "body").alias("evidence")), "id").select("card", "line_no", "claim", "id", "evidence")


def secret_lines(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, line_no): the first line of texts(id, text) that a secret pattern matches; the line itself is not told."""
    from tessella.operators.rules import any_of

    lines = texts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(any_of(F.col("line"), patterns))
    return lines.groupBy("id").agg((F.min("at") + 1).alias("line_no"))


def card_state(cards: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """cards with obs_stale set again for every card: missing, superseded or changed basis, empty where it is fresh."""
    from tessella.operators.lifecycle import card_staleness

    told = card_staleness(cards.select("card", "basis", "written"), notes, as_of).select(F.col("card").alias("_card"), "reason")
    return cards.join(told, F.col("card") == F.col("_card"), "left").withColumn("obs_stale", F.when(F.coalesce("reason", F.lit("missing")) == "fresh", "").otherwise(F.coalesce("reason", F.lit("missing")))).drop("_card", "reason")


def fold_counts(plan: DataFrame, notes: DataFrame, as_of: str, warm: int = 1000, cold: int = 20_000) -> DataFrame:
    """One row: notes, planned, and whether there are so many notes that warm or cold folding begins."""
    planned = plan.agg(F.count("*").alias("planned"))
    total = notes.where(P.is_live(as_of)).agg(F.count("*").alias("notes"))
    return total.crossJoin(F.broadcast(planned)).select("notes", "planned", (F.col("notes") > warm).alias("warm"), (F.col("notes") > cold).alias("cold"))  # one row each
