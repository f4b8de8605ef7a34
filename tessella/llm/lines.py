"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are sequences of tokens: words, or characters where a line has over two bytes a character, as lines of scripts
without spaces have. Two lines are near when one edit of a token, or none, makes one the other and what is common to both
is at least four fifths of either line's characters. Deleting the edited token leaves both with an equal variant, so equal
hashes of variants find all near lines; the tokens then prove it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import maybe_in, with_row_key, written

TRIM = " \t\r\x0b\x0c"
#: White space within a trimmed line that is no single space.
ODD_SPACE = ("  ", "\t", "\r", "\x0b", "\x0c")


def _head(line: Column, n: Column) -> Column:
    """The first n words, or last -n ones, of a line whose words have single spaces between them."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def _half_keys(line: Column, n: Column, can: Column) -> Column:
    """Hashes of beginnings and ends of which near lines share one.

    One edit leaves a common beginning and a common end which together have all tokens but the edited one. Of lines of m
    and m or m + 1 tokens, one of both is therefore as long as half of what is common, rounded up. A line is the shorter
    one of such a pair, or, if it can lose a token, one of equal ones or the longer one. The lowest bit of a key tells
    whether it is of a beginning (0) or an end (1).
    """
    halves = (F.ceil(n / 2).cast("int"), F.when(can & (n % 2 == 1), F.ceil((n - 1) / 2).cast("int")))  # of an even n both are the same
    ends = [F.when(h > 0, F.shiftleft(F.xxhash64(h, _head(line, h if i == 0 else -h)), 1).bitwiseOR(F.lit(i))) for h in halves for i in (0, 1)]
    return F.array_compact(F.array_distinct(F.array(*ends)))


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """Lines that are not blank: row key f, p, line_no, tokens with single spaces, their number n, can (lose a token), 128-bit hash."""
    # within the array each line is put right once; columns after the explode are not worked out anew for every use

    def single(raw: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.contains(raw, F.lit(x)) for x in ODD_SPACE])  # far cheaper than a pattern
        return F.when(odd, F.regexp_replace(raw, r"[\x20\x09-\x0D]+", " ")).otherwise(raw)

    def tokens(line: Column) -> Column:
        wide = F.octet_length(line) > 2 * F.length(line)
        return F.when(wide, F.regexp_replace(F.replace(line, F.lit(" "), F.lit("")), "(.)(?=.)", "$1 ")).otherwise(line)

    trimmed = F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(TRIM)))
    counted = F.transform(F.transform(F.transform(trimmed, single), lambda x: F.struct(x.alias("plain"), tokens(x).alias("line"))), lambda x: F.struct(x["plain"], x["line"], (F.octet_length(x["line"]) - F.octet_length(F.replace(x["line"], F.lit(" "), F.lit(""))) + 1).alias("n")))
    lines = docs.select("_id", "f", "p", F.posexplode(counted).alias("line_no", "x")).select("_id", "f", "p", "line_no", "x.plain", "x.line", "x.n")
    # the shortest of six tokens is never more than a fifth of the line; of fewer it is looked at
    shortest = F.array_min(F.transform(F.split("line", " ", -1), lambda w: F.length(w)))
    can = F.when(F.col("n") >= 6, True).when(F.col("n") == 1, False).otherwise((shortest + 1) * 5 <= F.length("line"))
    return lines.where(F.col("plain") != "").select("_id", "f", "p", "line_no", "line", "n", can.alias("can"), F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(7), "plain").alias("h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_exact, n_near, dropped (line numbers from 0, comma-joined).

    Lines are what "\\n" separates; blank ones are never dropped, and white space tells no lines apart. Lines come in order
    of id (null last), stored row and line number. A line, however short, goes as exact if an earlier line is the same; of
    different lines, one goes as near, with all its copies, if a line whose first copy is earlier is within one inserted,
    deleted or replaced token of it and shares four fifths of both lines' characters. A null or empty text is one blank
    line. Repeated rows are told one by one: the second loses all its lines. An empty table gives no rows.
    """
    rows = with_row_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select("_id", "_text", F.col("_row.file").alias("f"), F.col("_row.pos").alias("p"))
    lines = _lines(rows, "_text")
    first = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), "f", "p", "line_no")
    told = written(lines.select("_id", "f", "p", "line_no", "h1", "h2", F.struct("can", _half_keys(F.col("line"), F.col("n"), F.col("can")).alias("keys")).alias("keys")), "lines")
    distinct = told.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"))
    distinct = written(distinct, "distinct")
    # only lines that share a half with another one can have near lines; the side they share tells where the edit is not
    keys = distinct.select("h1", "h2", "keys.can", F.explode("keys.keys").alias("k"))
    live = written(keys.groupBy("k").agg(F.count("*").alias("c"), F.bool_or("can").alias("can")).where("c > 1 AND can").select("k"), "live")
    side = F.col("k").bitwiseAND(F.lit(1)) == 1
    wanted = keys.where(maybe_in(F.col("k"), live, "k")).join(live, "k").groupBy("h1", "h2").agg(F.bool_or(~side).alias("heads"), F.bool_or(side).alias("tails"))
    wanted = written(wanted.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]), "wanted")
    # the texts of those lines, read again, only documents that have a first copy being cut; a line is told once, by that copy
    holders = rows.where(maybe_in(F.xxhash64("f", "p"), wanted.select(F.xxhash64("first.f", "first.p").alias("doc")), "doc"))
    again = _lines(holders, "_text").where(maybe_in(F.col("h1"), wanted, "h1")).select("h1", "h2", F.col("f").alias("f1"), F.col("p").alias("p1"), F.col("line_no").alias("l1"), "line", "n")
    chosen = wanted.withColumnsRenamed({"h1": "w1", "h2": "w2"})
    here = (F.col("f1") == F.col("first.f")) & (F.col("p1") == F.col("first.p")) & (F.col("l1") == F.col("first.line_no")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))
    near = written(again.join(chosen, here).select("h1", "h2", "first", "heads", "tails", "line", "n"), "near")
    # a variant of position 0 is the line itself, of position i the line without its i-th token, if enough is left
    half = F.floor(F.col("n") / 2).cast("int")
    near = near.withColumns({"size": F.length("line"), "sizes": F.transform(F.split("line", " ", -1), lambda w: F.length(w))})
    places = F.sequence(F.lit(0), F.col("n"))
    left = lambda i: F.col("size") - F.get("sizes", i - 1) - 1
    places = F.filter(places, lambda i: (i == 0) | (((F.col("tails") & (i <= half + 1)) | (F.col("heads") & (i >= half))) & (left(i) * 5 >= F.col("size") * 4)))
    spots = near.select("h1", "h2", "line", "n", F.explode(places).alias("i"))
    # worked out once for each place: no filter looks at the variant
    rest = F.concat_ws(" ", F.nullif(_head(F.col("line"), F.col("i") - 1), F.lit("")), F.nullif(_head(F.col("line"), F.col("i") - F.col("n")), F.lit("")))
    variants = written(spots.select("h1", "h2", "n", "i", F.xxhash64(F.when(F.col("i") == 0, F.col("line")).otherwise(rest)).alias("v")), "variants")
    met = written(variants.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select(F.col("v").alias("met")), "met")
    order = near.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "first")
    variants = variants.join(met, F.col("v") == F.col("met"), "left_semi")
    variants = written(variants.join(order, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2"))).drop("o1", "o2"), "variants")
    whole = F.col("i") == 0
    earliest = lambda when: F.min(F.when(when, F.struct("first", "h1", "h2")))
    same_place = variants.groupBy("v", "n", "i").agg(F.min(F.struct("first", "h1", "h2")).alias("m"), F.count("*").alias("c")).where("c > 1").select(F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("i").alias("i2"), "m")
    moved = variants.groupBy("v").agg(earliest(whole).alias("a"), earliest(~whole).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select(F.col("v").alias("v2"), "a", "b")
    other = F.when(whole, F.col("b")).otherwise(F.col("a"))
    pairs = [
        variants.join(written(same_place, "same"), (F.col("v") == F.col("v2")) & (F.col("n") == F.col("n2")) & (F.col("i") == F.col("i2"))).select("h1", "h2", "first", "m"),
        variants.join(written(moved, "moved"), F.col("v") == F.col("v2")).select("h1", "h2", "first", other.alias("m")),
    ]
    pairs = reduce(DataFrame.unionByName, pairs).where("m.first < first").select("h1", "h2", F.col("m.h1").alias("g1"), F.col("m.h2").alias("g2")).distinct()
    words = F.split("line", " ", -1)
    left, right = near.select("h1", "h2", words.alias("x")), near.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), words.alias("y"))
    both = written(written(pairs, "pairs").join(left, ["h1", "h2"]), "left").join(right, (F.col("g1") == F.col("o1")) & (F.col("g2") == F.col("o2")))
    common = lambda a, b: F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda s, t: s.eqNullSafe(t)), False), F.lit(0)) - 1, F.least(F.size(a), F.size(b)))
    longer = F.greatest(F.size("x"), F.size("y"))
    close = (F.abs(F.size("x") - F.size("y")) <= 1) & (common(F.col("x"), F.col("y")) + common(F.reverse("x"), F.reverse("y")) >= longer - 1)
    gone = written(both.where(close).select("h1", "h2").distinct(), "gone")
    # lines of one copy without a near one stay, and need no verdict
    verdict = distinct.drop("keys").join(gone.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("copies > 1 OR near")
    verdict = written(verdict.select(F.col("h1").alias("d1"), F.col("h2").alias("d2"), "first", F.coalesce("near", F.lit(False)).alias("near")), "verdict")
    original = (F.col("first.f") == F.col("f")) & (F.col("first.p") == F.col("p")) & (F.col("first.line_no") == F.col("line_no"))
    judged = told.select("f", "p", "line_no", "h1", "h2").where(maybe_in(F.col("h1"), verdict, "d1")).join(verdict, (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2"))).select("f", "p", "line_no", original.alias("original"), "near")
    drops = judged.where("near OR NOT original").groupBy("f", "p").agg(
        F.sum((~F.col("original")).cast("long")).alias("n_exact"), F.sum(F.col("original").cast("long")).alias("n_near"), F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("dropped")
    ).withColumnsRenamed({"f": "f2", "p": "p2"})
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    every = rows.select("_id", "f", "p", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return every.join(drops, (F.col("f") == F.col("f2")) & (F.col("p") == F.col("p2")), "left").select(
        F.col("_id").alias(id_col), (F.col("breaks") + 1).alias("n_lines"), none("n_exact").alias("n_exact"), none("n_near").alias("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped")
    )


def without_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of their texts; ids must be unique. A text that loses no line stays as it is."""
    drop = verdicts.where("dropped <> ''").select(F.col(id_col).alias("_drop_id"), F.split("dropped", ",").alias("_drop"))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_drop", i.cast("string"))), "\n")
    joined = docs.join(drop, docs[id_col] == drop["_drop_id"], "left")
    return joined.withColumn(text_col, F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(kept)).drop("_drop_id", "_drop")
