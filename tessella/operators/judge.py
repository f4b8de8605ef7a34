"""Judging claims against evidence by rules: flipped negations, numbers apart, nothing in common; and the candidate gate.

The rules look at the places of words within short sentences, so they run as one Arrow function over the pairs.
"""

from __future__ import annotations

import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X

# Plain forms and the form that flips them.
NEGATIONS = [
    (["한다"], "안 한다"), (["된다"], "안 된다"), (["기본 켬"], "기본 끔"), (["있다"], "없다"), (["넣는다"], "뺀다"), (["켠다"], "끈다"),
    (["늘린다"], "줄인다"), (["늘었다"], "줄었다"), (["늘어"], "줄어"), (["통과", "합격"], "미달"), (["올린다"], "내린다"),
]
# Units with their group and scale, longer names first.
UNITS = [
    ("시간", "time", 3600000), ("ms", "time", 1), ("초", "time", 1000), ("분", "time", 60000), ("s", "time", 1000), ("gb", "size", 1000000), ("mb", "size", 1000), ("kb", "size", 1),
    ("%", "%", 1), ("종", "종", 1), ("배", "배", 1), ("건", "건", 1), ("쌍", "쌍", 1), ("개", "개", 1), ("줄", "줄", 1), ("판", "판", 1), ("번", "번", 1), ("회", "회", 1), ("자", "자", 1), ("원", "원", 1),
]
#: Largest relative gap of equal numbers, words before that make a place, digits of a value, limits of unrelated texts.
GAP, PLACE, DIGITS, LEAST_WORDS, LEAST_GRAMS = 0.05, 2, 12, 0.05, 0.10
_GLUED = re.compile(r"(?<![^\W_])안(?=한다|된다)")
_NUMBER = re.compile(r"(?<![A-Za-z\-.~:/_])(?<!\d,)(?<!\d)(\d{1,3}(?:,\d{3})+|\d+)(?!\d)(?![-.~:/_]|,\d)")
_UNIT = re.compile("|".join(f"{u}(?![A-Za-z])" if u.isascii() and u.isalpha() else u for u, *_ in UNITS), re.IGNORECASE)


def word_list(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, of two characters or more."""
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) > 1]


def _place(text: str, at: int) -> set[str]:
    return set(word_list(text[:at])[-PLACE:])


def _spots(text: str, form: str, flipped: str) -> list[int]:
    """Where a form stands; a plain form that is part of the flipped one does not count inside it."""
    covered = {m.start() + flipped.find(form) for m in re.finditer(re.escape(flipped), text)} if form != flipped and form in flipped else set()
    return [m.start() for m in re.finditer(re.escape(form), text) if m.start() not in covered]


def negated(evidence: str, claim: str) -> str | None:
    """`neg:a→b` where the evidence says a and the claim b in the same place, and neither says the other."""
    e, c = (_GLUED.sub("안 ", t) for t in (evidence, claim))
    for plains, flipped in NEGATIONS:
        for a, b in [ab for p in plains for ab in ((p, flipped), (flipped, p))]:
            if _spots(c, a, flipped) or _spots(e, b, flipped):
                continue
            if any(_place(e, i) & _place(c, j) for i in _spots(e, a, flipped) for j in _spots(c, b, flipped)):
                return f"neg:{a}→{b}"
    return None


def values(text: str) -> list[tuple[str, str, float, set[str]]]:
    """(text, unit group, scaled value, words before) of plain numbers with a unit; dates, versions and ranges are none."""
    out = []
    for m in _NUMBER.finditer(text):
        digits, unit = m[1].replace(",", ""), _UNIT.match(text, m.end())
        if unit and len(digits) <= DIGITS:
            _, group, scale = next(u for u in UNITS if u[0] == unit[0].lower())
            out.append((m[1] + unit[0], group, float(digits) * scale, _place(text, m.start())))
    return out


def same_value(a: float, b: float) -> bool:
    """Within the gap, or, in one order of magnitude, one of them is the other rounded to its own last digit."""
    if max(a, b) == 0 or abs(a - b) <= GAP * max(a, b):
        return True
    if min(a, b) <= 0 or math.floor(math.log10(a)) != math.floor(math.log10(b)):
        return False
    step = lambda x: 10.0 ** Decimal(repr(x)).normalize().as_tuple().exponent
    half_up = lambda x, s: math.floor(x / s + 0.5) * s
    return half_up(b, step(a)) == a or half_up(a, step(b)) == b


def number_apart(evidence: str, claim: str) -> str | None:
    """`num:a≠b` for a number of the claim that no number of its unit and place in the evidence equals, but one contradicts."""
    known = values(evidence)
    for text, group, value, place in values(claim):
        rivals = [k for k in known if k[1] == group and k[3] & place]
        if rivals and not any(same_value(k[2], value) for k in rivals):
            return f"num:{rivals[0][0]}≠{text}"
    return None


def _pairs_of(text: str) -> set[str]:
    t = "".join(text.lower().split())
    return {t[i : i + 2] for i in range(len(t) - 1)}


def overlap(evidence: str, claim: str) -> float | None:
    """Share of the claim's character pairs that the evidence has; None if one of both has no pair."""
    c, e = _pairs_of(claim), _pairs_of(evidence)
    return len(c & e) / len(c) if c and e else None


def unrelated(evidence: str, claim: str) -> str | None:
    """`unrelated:...` where words and character pairs hardly meet, no unit is common and no negation pair is split between both."""
    a, b = set(word_list(evidence)), set(word_list(claim))
    jaccard = len(a & b) / len(a | b) if a | b else 0.0
    share = overlap(evidence, claim)
    if share is None or jaccard >= LEAST_WORDS or share >= LEAST_GRAMS:
        return None
    if {v[1] for v in values(evidence)} & {v[1] for v in values(claim)}:
        return None
    e, c = (_GLUED.sub("안 ", t) for t in (evidence, claim))
    if any((p in e and f in c) or (f in e and p in c) for ps, f in NEGATIONS for p in ps):
        return None
    return f"unrelated:j{jaccard:.2f}/b{share:.2f}"


def rule_verdict(evidence: str | None, claim: str | None) -> tuple[str, str | None]:
    """(label, reason): contradicts, unrelated, or unsure where no rule speaks; null texts count as empty."""
    e, c = evidence or "", claim or ""
    if why := negated(e, c) or number_apart(e, c):
        return "contradicts", why
    why = unrelated(e, c)
    return ("unrelated", why) if why else ("unsure", None)


def judge(pairs: DataFrame, model=None, least: float = 0.7) -> DataFrame:
    """pairs(evidence, claim, ...) with label (contradicts, unrelated, supports, unsure), reason and by (rules, model or null).

    Rules come first. Where they are unsure, `model`, if given, is asked: a function of (evidence, claim) that returns the
    probabilities of support, contradiction and unrelatedness, of which the largest counts if it is `least` or more.
    """
    names = ("supports", "contradicts", "unrelated")

    @F.pandas_udf("label string, reason string, by string")
    def told(evidence: pd.Series, claim: pd.Series) -> pd.DataFrame:
        out = []
        for e, c in zip(evidence, claim, strict=True):
            label, reason = rule_verdict(e, c)
            by = "rules" if reason else None
            if model is not None and not reason:
                p = [float(x) for x in model(e or "", c or "")]
                if max(p) >= least:
                    label, reason, by = names[p.index(max(p))], f"model:{max(p):.2f}", "model"
            out.append((label, reason, by))
        return pd.DataFrame(out, columns=["label", "reason", "by"])

    return pairs.withColumn("_verdict", told("evidence", "claim")).select(*pairs.columns, "_verdict.label", "_verdict.reason", "_verdict.by")


def supported(label: str, known: bool = True) -> tuple[bool, bool]:
    """(supported, known) of a verdict: only a clear contradiction or an unrelated evidence is a non-support."""
    return label not in ("contradicts", "unrelated"), known and label in ("supports", "contradicts", "unrelated")


def quotes_support(quotes: DataFrame, model=None) -> DataFrame:
    """(id, ok) of quotes(id, quote, summary): every quote alone or all of them joined must not speak against the summary."""
    each = judge(quotes.select("id", F.col("quote").alias("evidence"), F.col("summary").alias("claim")), model)
    alone = each.groupBy("id").agg(F.bool_and(~F.col("label").isin("contradicts", "unrelated")).alias("alone"))
    bundle = quotes.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("quote")), "\n").alias("evidence"), F.first("summary").alias("claim"))
    whole = judge(bundle, model).select(F.col("id").alias("_id"), (~F.col("label").isin("contradicts", "unrelated")).alias("whole"))
    return alone.join(whole, F.col("id") == F.col("_id")).select("id", (F.col("alone") | F.col("whole")).alias("ok"))


def candidate_gate(candidates: DataFrame, talk: DataFrame, per_session: int = 5, per_day: int = 20) -> DataFrame:
    """(id, ok, broken) of candidates(id, session, day, summary, quotes, sources) against talk(session, text).

    R2: one to three quotes of 15 characters or more, each found in the folded conversation; R4: numbers, paths, dates
    and ids of the summary occur there; R5: caps by session and day; R6: sources are there.
    """
    folded = talk.groupBy("session").agg(X.fold(F.array_join(F.collect_list("text"), "\n")).alias("talk"))
    joined = candidates.join(folded, "session", "left").withColumn("talk", F.coalesce("talk", F.lit("")))
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("id"))
    rows = joined.withColumn("in_session", by("session")).withColumn("in_day", by("day"))
    quotes = F.size("quotes").between(1, 3) & F.forall("quotes", lambda q: (F.length(q) >= 15) & F.contains(F.col("talk"), X.fold(q)))
    known = F.forall(X.fragments(F.col("summary")), lambda f: F.contains(F.col("talk"), X.fold(f["value"])))
    caps = (F.col("in_session") <= per_session) & (F.col("in_day") <= per_day)
    checks = {"R2": quotes, "R4": known, "R5": caps, "R6": F.size("sources") > 0}
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select("id", (F.size(broken) == 0).alias("ok"), F.array_join(broken, ",").alias("broken"))
