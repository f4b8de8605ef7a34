"""Exact dedup by exchanging Golomb-coded fingerprints.

Every partition (a sender) hashes its own texts and keeps the digests; to each owner of a range of fingerprints it
sends the sorted distinct ones, delta- and Golomb-coded. Owners answer with bitmaps that mark fingerprints seen by
more than one sender. Only the texts of suspects are then shuffled, to be compared byte for byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import kept_fields, schema, written
from tessella.llm.golomb import golomb_decode, golomb_encode

SPACE = b" \t\n\x0b\x0c\r"
FP_BITS = 48
#: Fingerprints that an owner compares in memory, about.
OWNED = 2_000_000
#: Rows whose digests a sender holds before it sends them.
SENT = 1_000_000
_SAFE = pa.binary()


def _norm(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE)


def _send(carry: list[str], owners: int, out: pa.Schema):
    """Rows (digests) and, after every SENT rows and at the end of the partition, one message per owner."""
    span = -(-(1 << FP_BITS) // owners)

    def flush(sender: int, parts: list, shas: list, chars: list):
        n = len(shas)
        fp = np.array([int.from_bytes(s[:6], "big") for s in shas], np.int64)
        distinct, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
        owner = distinct // span
        to, cuts = np.unique(owner, return_index=True)
        first = cuts[np.searchsorted(to, owner)]
        columns = pa.Table.from_batches(parts).combine_chunks()
        rows = [
            pa.array(np.full(n, sender, np.int64)), pa.array(np.arange(n)), pa.array(shas, _SAFE), pa.array(np.concatenate(chars)),
            pa.array(owner[inverse]), pa.array(inverse - first[inverse]), pa.array(count[inverse] > 1), pa.nulls(n, _SAFE),
        ]
        carried = [c.chunk(0) if c.num_chunks else pa.nulls(0, c.type) for c in columns.columns]
        yield from pa.Table.from_arrays([*carried, *rows], schema=out).to_batches(max_chunksize=10_000)
        sent = [golomb_encode(x - o * span, span) for o, x in zip(to, np.split(distinct, cuts[1:]), strict=True)]
        m = len(sent)
        message = [
            pa.array(np.full(m, sender, np.int64)), *(pa.nulls(m, f.type) for f in list(out)[len(carry) + 1 : len(carry) + 4]),
            pa.array(to, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(sent, _SAFE),
        ]
        yield from pa.Table.from_arrays([*(pa.nulls(m, f.type) for f in list(out)[: len(carry)]), *message], schema=out).to_batches(max_chunksize=10_000)

    def run(batches):
        sender = TaskContext.get().partitionId() << 24
        parts, shas, chars = [], [], []
        for b in batches:
            text = b.column("_text")
            chars.append(pa.compute.fill_null(pa.compute.utf8_length(text), 0).cast(pa.int64()).to_numpy())
            shas += [hashlib.sha256(_norm(t)).digest() for t in text.cast(_SAFE).to_pylist()]
            parts.append(b.select(carry))
            if len(shas) >= SENT:
                yield from flush(sender, parts, shas, chars)
                sender, parts, shas, chars = sender + 1, [], [], []
        if shas:
            yield from flush(sender, parts, shas, chars)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """An owner's bitmaps: for each sender's list, which fingerprints another sender has as well."""
    lists = [golomb_decode(x) for x in table.column("payload").to_pylist()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    maps = [np.packbits(np.isin(x, twice)).tobytes() for x in lists]
    some = [bool(np.isin(x, twice).any()) for x in lists]
    return pa.table({"to": table.column("sender"), "of": table.column("owner"), "bitmap": pa.array(maps, _SAFE)}).filter(pa.array(some))


def _suspects(bits: np.ndarray):
    """(sha, norm) of texts whose fingerprint may be a suspect's: a superset, thinned by a bit table of fixed size."""
    mask = len(bits) * 64 - 1

    def run(batches):
        for b in batches:
            found = {}
            for t in b.column("_text").cast(_SAFE).to_pylist():
                norm = _norm(t)
                sha = hashlib.sha256(norm).digest()
                h = int.from_bytes(sha[:6], "big") & mask
                if int(bits[h >> 6]) >> (h & 63) & 1:
                    found[norm] = sha  # equal keys are equal bytes
            yield pa.RecordBatch.from_arrays([pa.array(list(found.values()), _SAFE), pa.array(list(found), _SAFE)], ["sha", "norm"])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, owners: int | None = None, most_bits: int = 1 << 29) -> DataFrame:
    """One row per document: id, the carried columns, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without ASCII white space; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest id; a null id comes last, and of rows alike in both the first stored
    one stays, so that exactly one row of a group is kept. owners: ranges of fingerprints, by default one for every
    OWNED rows, and as many as shuffle partitions at least, so that an owner's lists fit its task at any size. The bit
    table that is broadcast to pick suspects' texts has 16 bits a suspect, and most_bits (64 MB) at most: with more
    suspects more texts than needed are shuffled, never fewer, which costs one shuffle of the texts at worst. Extra
    columns of docs do not matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    carry = carry or []
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // OWNED)
    source = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate([id_col, *carry])], F.col(text_col).cast("string").alias("_text"))
    held = [f"_c{i}" for i in range(len(carry) + 1)]
    own = [("sender", T.LongType()), ("pos", T.LongType()), ("sha", T.BinaryType()), ("n_chars", T.LongType()), ("owner", T.LongType()), ("rank", T.LongType()), ("repeat", T.BooleanType()), ("payload", T.BinaryType())]
    out = schema(*kept_fields(source, held), *own)
    from pyspark.sql.pandas.types import to_arrow_schema

    table = written(source.mapInArrow(_send(held, owners, to_arrow_schema(out)), out), "digests")
    messages = table.where("payload is not null").select("sender", "owner", "payload")
    answers = messages.groupBy("owner").applyInArrow(_answer, "to long, of long, bitmap binary")
    rows = table.where("payload is null").drop("payload")
    bit = F.getbit(F.conv(F.hex(F.substring("bitmap", (F.col("rank") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long"), (7 - F.col("rank") % 8).cast("int"))
    marked = written(
        rows.join(answers, (F.col("sender") == F.col("to")) & (F.col("owner") == F.col("of")), "left")
        .withColumn("suspect", F.col("repeat") | F.coalesce(bit == 1, F.lit(False)))
        .drop("to", "of", "bitmap", "owner", "rank", "repeat"),
        "marked",
    )
    suspects = marked.where("suspect")
    fp = F.conv(F.hex(F.substring("sha", 1, 6)), 16, 10).cast("long")
    n = suspects.select(F.approx_count_distinct("sha")).first()[0]
    size = min(most_bits, 1 << max(16, (16 * n).bit_length()))
    slot = fp.bitwiseAND(F.lit(size - 1))
    words = suspects.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    texts = source.select("_text").mapInArrow(_suspects(bits), "sha binary, norm binary").distinct()
    proven = texts.groupBy("sha").agg(F.count("*").alias("texts"))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("_c0").isNull().alias("no_id"), F.col("_c0").alias("id"), "sender", "pos")).alias("best")
    groups = suspects.groupBy("sha").agg(F.count("*").alias("size"), best).join(proven, "sha")
    groups = written(groups.withColumn("size", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))), "groups")
    here = groups.select(F.col("sha").alias("_sha"), "size", "best")
    told = suspects.join(here, F.col("sha") == F.col("_sha"))
    names = [F.col(f"_c{i}").alias(c) for i, c in enumerate([id_col, *carry])]
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    stays = (F.col("best.sender") == F.col("sender")) & (F.col("best.pos") == F.col("pos"))
    alone = marked.where("not suspect").select(*names, F.col("_c0").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return told.select(*names, F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), sha).unionByName(alone)
