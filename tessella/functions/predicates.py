"""Boolean Columns over notes: liveness, staleness, filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def not_superseded() -> Column:
    return F.coalesce(F.col("superseded_by").cast("string"), F.lit("")) == ""


def is_live(as_of: str) -> Column:
    """Not superseded, and not invalid yet."""
    return not_superseded() & (F.col("invalid_at").isNull() | (F.col("invalid_at") > day(as_of)))


def is_hook_live() -> Column:
    """Not superseded, and with no end at all: the stricter reading that context blocks use."""
    return not_superseded() & F.col("invalid_at").isNull()


def is_dead(as_of: str) -> Column:
    return ~is_live(as_of)


def snoozed(as_of: str) -> Column:
    return F.coalesce(F.col("stale_after") > day(as_of), F.lit(False))


def folded() -> Column:
    return F.col("state").isin("warm", "cold") | (F.coalesce(F.col("archived"), F.lit("")) != "")


@dataclass(frozen=True)
class Narrow:
    """A filter: types and tags are lists, scope also admits the scope `all`, dates are half-open."""

    types: tuple[str, ...] = ()
    scope: str | None = None
    tags: tuple[str, ...] = ()
    pinned: bool | None = None
    since: str | None = None
    until: str | None = None
    dead: bool = False
    more: tuple[Column, ...] = field(default=())


def where_of(narrow: Narrow, as_of: str) -> Column:
    parts = [F.lit(True), *narrow.more]
    if not narrow.dead:
        parts.append(is_live(as_of))
    if narrow.types:
        parts.append(F.col("type").isin(*narrow.types))
    if narrow.scope:
        parts.append(F.col("scope").isin(narrow.scope, "all"))
    parts += [F.array_contains("tags", t) for t in narrow.tags]
    if narrow.pinned is not None:
        parts.append(F.col("pinned") == narrow.pinned)
    if narrow.since:
        parts.append(F.col("created") >= day(narrow.since))
    if narrow.until:
        parts.append(F.col("created") < day(narrow.until))
    return reduce(lambda a, b: a & b, parts)


def need_of(n: int) -> int:
    """How many of n findable words a document must have."""
    return max(1, (n + 1) // 2)


def majority_of(n: int) -> int:
    """How many of n words must be findable at all."""
    return 1 if n <= 1 else n // 2 + 1
