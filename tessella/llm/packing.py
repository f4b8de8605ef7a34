"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source's documents form a queue of tokens. A round-robin with deficit counters serves the queues window by window:
after w windows a source that holds a share of all tokens must have been given w times its share of a window, rounded
down; what the rounding withholds is its deficit and is carried into the next window, whichever partition that is in.
So how far each queue has come at every window's end follows from the queue totals alone, a task can place any token
of any document without hearing of other tasks, and every window has the target proportions to within a quantum a source.
A source is served in whole quanta of tokens, so that a small source is not strewn over the windows token by token.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import bounded_broadcast, kept_fields, schema, written
from tessella.llm.tokens import WordIds, shared


def _encode(tokenizer: str, n: int, names: list[str], end_id: int, memo: int):
    """Token ids per document, with their place in the part of the source's queue that this partition fills."""

    def run(batches):
        part, encoder, filled = TaskContext.get().partitionId(), shared(WordIds, tokenizer, 200, memo, end_id), {}
        end, wide = encoder.kind.type(end_id).tobytes(), encoder.kind.itemsize
        for b in batches:
            texts = b.column("_text").cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 2000):
                ids = [x + end for x in encoder.ids([t or b"" for t in texts[lo : lo + 2000]])]
                starts = []
                for s, x in zip(b.column("_source")[lo : lo + 2000].to_pylist(), ids, strict=True):
                    starts.append(filled.get(s, 0))
                    filled[s] = starts[-1] + len(x) // wide
                size = [len(x) // wide for x in ids]
                more = [pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(ids)) for c in b.columns[:n]), *more], names)

    return run


def served_by(total: list[int], windows: int, quantum: int):
    """A function of w: tokens that each queue has given by the end of the first w windows, all of them after the last.

    Quanta and remainders of the products are taken apart, so that they stay within 64 bits for up to 2^31 windows.
    """
    t = np.array(total, np.int64)
    whole, rest = np.divmod(t, windows)

    def serve(w: int) -> np.ndarray:
        if w >= windows:
            return t
        due = whole * w + rest * w // windows
        return due // quantum * quantum

    return serve


def _pieces(totals: dict, window: int, length: int, quantum: int, n: int, names: list[str]):
    """Pieces of each document: cut at the window's turns of its queue, then at sequence ends."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    total = [totals[s] for s in order]
    windows = max(1, -(-sum(total) // window))
    index = {s: i for i, s in enumerate(order)}
    serve = served_by(total, windows, quantum)

    def cut(served, source, begin: int, size: int):
        """(start, length, position on the line of all tokens), in order."""
        i, at, stop = index[source], begin, begin + size
        # the first window by whose end the queue has given more than `at`: the quantum that `at` is in is due then
        due = min(total[i], at // quantum * quantum + quantum)
        w = min(windows - 1, max(0, -(-due * windows // total[i]) - 1))
        while at < stop:
            before, after = served(w), served(w + 1)
            if int(after[i]) <= at:  # nothing of this queue, or of its rest, is due yet
                w = min(windows - 1, max(w + 1, -(-min(total[i], at // quantum * quantum + quantum) * windows // total[i]) - 1))
                continue
            turn = int(before.sum() + (after - before)[:i].sum())
            upto = min(stop, int(after[i]))
            place = turn + at - int(before[i])
            while at < upto:
                take = min(upto - at, length - place % length)
                yield at - begin, take, place
                at, place = at + take, place + take
            w += 1

    def run(batches):
        served = lru_cache(1024)(serve)
        for b in batches:
            keep, rows = [], []
            for k, (s, at, size, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_source", "at", "size", "ids")), strict=True)):
                ids = np.frombuffer(data, np.uint16 if len(data) == 2 * size else np.uint32).astype(np.uint32).tobytes()
                for start, take, place in cut(served, s, at, size):
                    keep.append(k)
                    rows.append((start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), size, place // length, place % length))
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in b.columns[:n]), *(pa.array(c) for c in columns)], names)

    return run


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, length: int = 2048, end_id: int = 1, window_sequences: int = 64, quantum: int = 256, most_sources: int = 200_000, memo: int = 48 << 20) -> DataFrame:
    """One row per piece: id, the carried columns, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then end_id; a null or empty text is end_id alone. Sequences are `length` tokens,
    all full but the last, and follow the windows of `window_sequences` sequences each, in which every source has its
    share of all tokens, to within `quantum` tokens; a null source is a source of its own. Documents are cut where a turn
    of their queue or a sequence ends. Reruns over the same files agree. Repeated rows are packed one by one; an empty
    table gives no rows. Source totals, a row a source, are sent to all tasks; more than most_sources sources share that
    many queues by hash, which keep the proportions of what shares a queue by the order of documents only.
    """
    spark, carry = docs.sparkSession, carry or []
    held = [f"_c{i}" for i in range(len(carry) + 1)]
    source = F.col(source_col).cast("string")
    if docs.select(source.alias("s")).distinct().limit(most_sources + 1).count() > most_sources:
        source = F.pmod(F.xxhash64(source), F.lit(most_sources)).cast("string")
    plain = docs.select(*[F.col(c).alias(h) for c, h in zip([id_col, *carry], held, strict=True)], source.alias("_source"), F.col(text_col).cast("string").alias("_text"))
    mid = schema(*kept_fields(plain, [*held, "_source"]), ("part", T.LongType()), ("begin", T.LongType()), ("size", T.LongType()), ("ids", T.BinaryType()))
    queues = written(plain.mapInArrow(_encode(tokenizer, len(held) + 1, mid.names, end_id, memo), mid), "queues")
    filled = written(queues.groupBy("part", "_source").agg(F.sum("size").alias("n")), "filled")
    totals = {r["_source"]: r["n"] for r in filled.groupBy("_source").agg(F.sum("n").alias("n")).collect()}
    ahead = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = filled.select(F.col("part").alias("_part"), F.col("_source").alias("_s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    base = bounded_broadcast(written(base, "bases"), 200_000)
    names = [*held, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = queues.join(base, (F.col("part") == F.col("_part")) & F.col("_source").eqNullSafe(F.col("_s"))).select(*held, "_source", (F.col("begin") + F.col("base")).alias("at"), "size", "ids")
    out = schema(*kept_fields(plain, held), *[(c, T.LongType()) for c in names[len(held) :]])
    pieces = placed.mapInArrow(_pieces(totals, window_sequences * length, length, quantum, len(held), names), out)
    return pieces.toDF(*[id_col, *carry], *names[len(held) :])
