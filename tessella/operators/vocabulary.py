"""Tag and scope vocabularies: aliases, parents, deny lists, near tags, suggestions."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "kind string, word string, canonical string, parent string, denied boolean"


def parse(spark: SparkSession, text: str) -> DataFrame:
    """(kind, word, canonical, parent, denied) of a TOML text with tables `tags`, `scopes` and a list `deny`.

    tags: canonical = {aliases = [...], children = [...]}; scopes: canonical = {aliases = [...]}. A canonical word is a row
    of its own; a word twice is an error.
    """
    data, rows = tomllib.loads(text), []
    for kind, table in (("tag", data.get("tags", {})), ("scope", data.get("scopes", {}))):
        for name, entry in table.items():
            rows.append((kind, name.lower(), name.lower(), None, False))
            rows += [(kind, a.lower(), name.lower(), None, False) for a in entry.get("aliases", [])]
            rows += [(kind, c.lower(), c.lower(), name.lower(), False) for c in entry.get("children", [])]
    rows += [("tag", d.lower(), d.lower(), None, True) for d in data.get("deny", [])]
    names = [r[:2] for r in rows]
    if len(names) != len(set(names)):
        raise ValueError("a word is there twice")
    return spark.createDataFrame(rows, VOCABULARY)


def normalised(words: DataFrame, vocabulary: DataFrame, kind: str) -> DataFrame:
    """words(word, ...) with canonical, standard and changed: lower case, trimmed, aliases replaced."""
    own = vocabulary.where((F.col("kind") == kind) & ~F.col("denied")).select(F.col("word").alias("_w"), F.col("canonical").alias("_c"))
    low = F.lower(F.btrim("word"))
    joined = words.withColumn("_low", low).join(own, F.col("_low") == F.col("_w"), "left")
    canonical = F.coalesce("_c", "_low")
    return joined.select(*words.columns, canonical.alias("canonical"), F.col("_c").isNotNull().alias("standard"), (canonical != F.col("word")).alias("changed"))


def standard_tags(vocabulary: DataFrame) -> DataFrame:
    """All canonical tags, parents and children, in order."""
    return vocabulary.where("kind = 'tag' AND NOT denied").select(F.col("canonical").alias("tag")).distinct().orderBy("tag")


def parents(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.where("kind = 'tag' AND parent IS NOT NULL").select(F.col("word").alias("tag"), "parent")


def near_tags(tags: DataFrame, standard: DataFrame, most: int = 3) -> DataFrame:
    """(tag, near, distance, place): the closest standard tags of each off-list one.

    Near are tags that contain one another, share a beginning of half their length, or are within a third of the length in
    edits. Tags meet by their first two letters or a shared part between hyphens, so that vocabularies are not crossed.
    """
    keys = lambda c: F.array_distinct(F.concat(F.array(F.left(c, F.lit(2))), F.filter(F.split(c, "-"), lambda p: F.length(p) > 1)))
    off = tags.select("tag").distinct().join(standard.select("tag"), "tag", "left_anti")
    a = off.select("tag", F.explode(keys("tag")).alias("key"))
    b = standard.select(F.col("tag").alias("near"), F.explode(keys("tag")).alias("key"))
    met = a.join(b, "key").select("tag", "near").distinct().withColumn("distance", F.levenshtein("tag", "near"))
    longest = F.greatest(F.length("tag"), F.length("near"))
    head = F.left("tag", F.ceil(longest / 2).cast("int")) == F.left("near", F.ceil(longest / 2).cast("int"))
    good = F.contains("tag", F.col("near")) | F.contains("near", F.col("tag")) | head | (F.col("distance") <= longest / 3)
    place = F.row_number().over(Window.partitionBy("tag").orderBy("distance", "near"))
    return met.where(good).withColumn("place", place).where(F.col("place") <= most)


def drift(notes: DataFrame, standard: DataFrame, most: int = 3) -> DataFrame:
    """(tag, notes, near): off-list tags with how many notes have them and the standard tags near them."""
    uses = notes.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("notes"))
    near = near_tags(uses, standard, most).groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "near"))), lambda x: x["near"]).alias("near"))
    return uses.join(near, "tag")


def bracketed(notes: DataFrame, least: int = 2) -> DataFrame:
    """(word, other, n): words given in another script between brackets, X(Y), by as many notes or more: synonyms to suggest."""
    text = F.concat_ws("\n", "title", "summary", "body")
    pattern = r"([가-힣]{2,}|[A-Za-z][A-Za-z0-9-]+)\(([가-힣]{2,}|[A-Za-z][A-Za-z0-9-]+)\)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("word"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("other"))
    rows = notes.select("id", F.explode(F.array_distinct(both)).alias("x")).select("id", F.lower("x.word").alias("word"), F.lower("x.other").alias("other"))
    hangul = lambda c: F.regexp_like(c, F.lit("^[가-힣]"))
    return rows.where(hangul("word") != hangul("other")).groupBy("word", "other").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= least)


def missed_words(log: DataFrame, least: int = 3) -> DataFrame:
    """(word, n) of words in a log(query) of queries without a hit."""
    from tessella.functions import text as X

    return log.select(F.explode(X.words(F.col("query"), 2)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
