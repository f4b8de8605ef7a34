"""Language ID by string kernels: blended-spectrum n-gram presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import bounded_broadcast, kept_fields, release, schema, written

#: A letter is what Unicode's category L says, here as in Spark's patterns: no fraction, circled digit or Roman numeral.
LETTER = regex.compile(r"\p{L}")
#: Presence bits of all byte pairs, then of hashed byte triples and quadruples.
PAIRS, HASHED = 1 << 16, 1 << 15
SPAN = PAIRS + 2 * HASHED


def grams(text: str) -> list[np.ndarray]:
    """Codes of the byte 2-, 3- and 4-grams of the whole lower-cased text, repeats included."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    four = three[:-1] << 8 | b[3:]
    mix = lambda x, by: (x * np.uint32(by) >> np.uint32(17)).astype(np.uint32)
    return [two, PAIRS + mix(three, 2654435761), PAIRS + HASHED + mix(four, 2246822519)]


def presence_bits(text: str) -> np.ndarray:
    """The presence of every gram as packed bits: SPAN / 8 bytes, however long the text."""
    here = np.zeros(SPAN, bool)
    for g in grams(text):
        here[g] = True
    return np.packbits(here)


class Spectrum:
    """Presence vectors over the n-grams that at least two texts of the sample have, each length scaled to unit norm."""

    def __init__(self, bits: list[np.ndarray], most: int) -> None:
        seen = np.zeros(SPAN, np.int64)
        for b in bits:
            seen += np.unpackbits(b)
        ranks = np.argsort(-seen, kind="stable")[:most]
        self.codes = np.sort(ranks[seen[ranks] > 1])
        cuts = np.searchsorted(self.codes, [0, PAIRS, PAIRS + HASHED, SPAN])
        self.blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _scaled(self, out: np.ndarray) -> np.ndarray:
        for block in self.blocks:  # the kernel of each length is a cosine of sets; the blend is their mean
            norm = np.sqrt(out[:, block].sum(1, keepdims=True))
            out[:, block] /= np.maximum(norm, 1) * np.float32(np.sqrt(len(self.blocks)))
        return out

    def of_bits(self, bits: list[np.ndarray]) -> np.ndarray:
        return self._scaled(np.stack([np.unpackbits(b)[self.codes] for b in bits]).astype(np.float32))

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.codes)), np.float32)
        for i, t in enumerate(texts):
            here = np.zeros(SPAN, np.float32)
            for g in grams(t):
                here[g] = 1
            out[i] = here[self.codes]
        return self._scaled(out)


class Classifier:
    """Kernel ridge regression, one output per language, on features of a Nyström approximation."""

    def __init__(self, bits: list[np.ndarray], labels: list[str], landmarks: int, ridge: float, grams: int, seed: int = 7) -> None:
        self.names = sorted(set(labels))
        self.spectrum = Spectrum(bits, grams)
        x = self.spectrum.of_bits(bits)
        pick = np.random.default_rng(seed).permutation(len(bits))[:landmarks]
        self.marks = x[np.sort(pick)]
        values, vectors = np.linalg.eigh(self.marks.astype(np.float64) @ self.marks.T)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = (x @ self.marks.T).astype(np.float64) @ root
        self.mean = z.mean(0)
        z -= self.mean
        share = np.array([labels.count(n) for n in self.names]) / len(labels)
        y = np.array([[label == n for n in self.names] for label in labels]) - share
        weight = np.array([1 / share[self.names.index(label)] for label in labels])  # every language counts alike
        beta = np.linalg.solve((z * weight[:, None]).T @ z + ridge * weight.sum() / 100 * np.eye(z.shape[1]), (z * weight[:, None]).T @ y)
        self.weights = (root @ beta).astype(np.float32)
        self.bias = (share - self.mean @ beta).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.spectrum.presence(texts) @ self.marks.T @ self.weights + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, values = ["und"] * len(texts), [0.0] * len(texts)
        good = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for lo in range(0, len(good), 256):
            at = good[lo : lo + 256]
            s = self.scores([texts[i] for i in at])
            for i, k, v in zip(at, s.argmax(1), np.clip(s.max(1), 0, 1), strict=True):
                names[i], values[i] = self.names[k], float(v)
        return names, values


def held_out(id_col: str) -> Column:
    """The fold that is never learned from; a null id is in no fold and counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, most_rows: int = 8192, least_rows: int = 16, landmarks: int = 192, ridge: float = 0.1, grams: int = 8192) -> Classifier | None:
    """A classifier from a bounded sample: labelled documents of every language, outside the held-out fold.

    A language has its per_language documents of smallest hash of the id, or fewer where there are so many languages that
    most_rows would be exceeded, but least_rows always. Texts are read whole, and come to the driver as packed presence
    bits of 16 KB each. Documents are scanned twice, whatever the number of languages: for a histogram of hashes by
    language, and for the texts below each language's cut. Landmarks grow with the languages beyond 64 of them. None if
    there is nothing to learn from; texts that are null or have no letter teach nothing.
    """
    order = F.xxhash64(F.col(id_col).cast("string"))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).where(F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), order.alias("h"), F.shiftright(order, 48).alias("slot"), F.col(text_col).alias("text"))
    slots = known.groupBy("lang", "slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumn("before", before)  # of at most 65,536 slots a language
    slots = written(slots, "slots")
    languages = slots.agg(F.countDistinct("lang")).first()[0]
    if not languages:
        return None
    quota = min(per_language, max(least_rows, most_rows // languages))
    cuts = written(slots.where(F.col("before") < quota).groupBy("lang").agg(F.max("slot").alias("cut")).withColumnRenamed("lang", "_lang"), "cuts")
    cuts = bounded_broadcast(cuts, 100_000)  # a row a language: no text is shuffled
    few = known.join(cuts, (F.col("lang") == F.col("_lang")) & (F.col("slot") <= F.col("cut")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))  # of a language's quota and the rest of one slot
    chosen = few.withColumn("place", place).where(F.col("place") <= quota).select("lang", "h", "text")

    def run(batches):
        for b in batches:
            bits = [presence_bits(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(bits, pa.binary())], ["lang", "h", "bits"])
        release()

    rows = sorted((r.lang, r.h, bytes(r.bits)) for r in chosen.mapInArrow(run, "lang string, h bigint, bits binary").collect())
    return Classifier([np.frombuffer(b, np.uint8) for *_, b in rows], [name for name, *_ in rows], max(landmarks, 3 * languages), ridge, grams)


def identify(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id, held_out, lang_pred, score and all other columns but the text, under their own names.

    A text that is null or has no letter is `und` with score 0; without a model all are. Every whole text is scored,
    whatever its length; repeated rows get equal answers; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, "held_out", "lang_pred", "score")]
    plain = docs.select(F.col(id_col), *[F.col(f"`{c}`") for c in others], held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    n = len(others) + 2
    out = schema(*kept_fields(plain, plain.columns[:n]), ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks x grams

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column("_text").to_pylist()
            names, values = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(names, pa.string()), pa.array(values, pa.float64())], out.names)
        release()

    return plain.mapInArrow(run, out)


def with_known_language(docs: DataFrame, model: Classifier | None, least: float = 0.2, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language: not `und`, and predicted with a score of `least` or more.

    Without a model, which means without any labelled text, only texts without letters go. Null and empty texts go;
    repeated rows share one fate; columns may have any names but each its own; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column(text_col).to_pylist()
            if model:
                good = [n != "und" and s >= least for n, s in zip(*model.predict(texts), strict=True)]
            else:
                good = [bool(t and LETTER.search(t)) for t in texts]
            yield b.filter(pa.array(good, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sizes) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; learned from docs' own labels outside the held-out fold.

    A text that is null or has no letter is `und` with score 0. Null ids count as held out; rows of equal text have equal
    answers; whole texts are read, however long; an empty table gives no rows, and other columns do not matter.
    """
    plain = docs.select(id_col, text_col, lang_col)
    return identify(plain.select(id_col, text_col), train(plain, id_col, text_col, lang_col, **sizes), id_col, text_col)
