"""What the operators share: the cluster's shared folder, written tables, stable row identities, prefix sums."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words are maximal runs of characters outside this ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set there is none, as a folder of one machine would be lost on the others: that is an error, but
    for a session whose executors all run in this very process, which makes a folder in its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read from there.

    This cuts the lineage: an executor lost later costs nothing but its running tasks. The folder goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the first of name_2, name_3, ... that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    tries = [name, *(f"{name}_{i}" for i in range(2, len(taken) + 3))]
    return next(n for n in tries if n.lower() not in taken)


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with a key that tells equal rows apart and stays the same on every read: struct(file, position).

    A frame that is no plain file scan is written to the shared folder first, as only stored rows have such a key. The
    name must be free (free_name); any other column may have any name, `_metadata` too.
    """
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"))
    plain = "_metadata" not in {c.lower() for c in df.columns}
    if plain:
        try:
            return df.select("*", key.alias(name))
        except Exception as e:  # no file scan: the hidden column is unknown
            if "UNRESOLVED_COLUMN" not in str(e) and "_metadata" not in str(e):
                raise
    # columns get plain names while the key is read, as one called _metadata would hide the files'; the folder's random
    # name is no part of the key, so that reruns give equal rows the same keys
    held = [f"c{i}" for i in range(len(df.columns))]
    file = F.xxhash64(F.regexp_replace("_metadata.file_name", "-[0-9a-f-]{36}-", "-"))
    stored = written(df.toDF(*held), "rows").select("*", F.struct(file.alias("file"), F.col("_metadata.row_index").alias("pos")).alias("key"))
    return stored.toDF(*df.columns, name)


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if a count finds at most so many rows, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def maybe_in(value: Column, wanted: DataFrame, column: str, most_words: int = 1 << 20) -> Column:
    """A test on 64-bit hashes by a bit table: true for all of wanted's, and for others by chance, about one in sixteen.

    It thins what an exact join shuffles. The table has 16 bits a wanted row, and 8 bytes x most_words (8 MB) at most;
    a fuller one lets more pass, all of them in the end, so that the join alone decides, which costs a shuffle more.
    """
    words = min(most_words, 1 << max(10, (wanted.count() // 4).bit_length()))
    slot = lambda c: F.shiftrightunsigned(c, 3).bitwiseAND(F.lit(words * 64 - 1))
    filled = wanted.select(slot(F.col(column)).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("b"))
    every = wanted.sparkSession.range(words).join(filled, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    table = every.agg(F.expr("transform(array_sort(collect_list(struct(id, b))), x -> x.b)").alias("bits"))
    bits = written(table, "bits").scalar()
    return F.getbit(F.element_at(bits, (F.shiftright(slot(value), 6) + 1).cast("int")), slot(value).bitwiseAND(F.lit(63)).cast("int")) == 1


def line_up(df: DataFrame, group: str, size: str, order: Column, slice_rows: int = 2000) -> DataFrame:
    """Adds `line_start`: the sum of `size` over the rows of the same group that come before, in pseudo-random order.

    `order` is a 64-bit hash. A group is cut into slices of the hash range, about slice_rows rows each, so that no
    task sees a whole group; slice totals get their prefix sums in a second, far smaller window.
    Rows with equal hash, group and size are interchangeable, so reruns give the same multiset of rows.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("_n") / slice_rows))
    unit = (F.shiftrightunsigned(F.col("_h"), 11) / F.lit(float(1 << 53))).cast("double")
    table = written(
        df.withColumn("_h", order)
        .join(bounded_broadcast(written(counts, "groups"), 10_000).withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
        .withColumn("_slice", F.least(F.floor(unit * slices), slices - 1).cast("long"))
        .drop("_g", "_n"),
        "line",
    )
    ahead = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        table.groupBy(group, "_slice").agg(F.sum(size).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).cast("long"))
        .select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), "_base")
    )
    within = Window.partitionBy(group, "_slice").orderBy("_h", size).rowsBetween(Window.unboundedPreceding, -1)
    return (
        table.withColumn("_own", F.coalesce(F.sum(size).over(within), F.lit(0)).cast("long"))
        .join(bases, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
        .withColumn("line_start", F.col("_own") + F.col("_base"))
        .drop("_g", "_s", "_slice", "_own", "_base", "_h")
    )


def release() -> None:
    """Gives the memory that a task has freed back to the machine, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def kept_fields(df: DataFrame, columns: list[str]) -> list[tuple[str, T.DataType]]:
    return [(c, df.schema[c].dataType) for c in columns]
