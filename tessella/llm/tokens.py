"""Token counts and token ids by public tokenizers, in Arrow functions.

A text is cut at safe boundaries only, where the tokenizer would cut anyway, so that the tokens of the parts are the
tokens of the text. Parts go to the tokenizer in batches balanced by bytes. A part that came before is not encoded
again: each worker remembers a bounded number of parts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import kept_fields, schema

#: Next to a space, these would join it to a longer run of white space.
_UNSAFE = re.compile(r"\s | \s|^ | $")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: In long parts without a space the pattern also cuts before single other white space, and from a letter or digit to another sign.
_FINE = regex.compile(r"(?<=\S)(?=\s\S)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])")
LONG = 4096


#: White space before these, after a letter, changes no cut of the word-level tokenizer. Not an apostrophe, which may begin
#: a suffix, and not what special tokens have; the sign comes before the look back, so that the search skips to it.
_MARK = re.compile(rb"[!-&(-/:;=-@\[-`{}~](?<=[A-Za-z].)")
_SHARED: dict[tuple, object] = {}


class Memo:
    """A part's value, for the parts of late, within a bound of bytes; the older half is forgotten when both halves are full."""

    #: What an entry takes besides its characters, about.
    ENTRY = 150

    def __init__(self, half: int) -> None:
        self.half, self.size, self.new, self.old = half, 0, {}, {}

    def missing(self, parts: set) -> list:
        """Those of the parts whose value is not known; old values in use stay longer."""
        old = self.old
        rest = parts.difference(self.new)  # of a plain dict: a look-up for each part
        again = [p for p in rest if p in old]
        self.put(again, map(old.__getitem__, again))
        return [p for p in rest if p not in old]

    def put(self, parts: list, values) -> None:
        self.new.update(zip(parts, values, strict=True))
        self.size += sum(map(len, parts)) + self.ENTRY * len(parts)

    def trim(self) -> None:
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0


def shared(kind: type, *args):
    """The kind's object for these arguments; a worker process keeps it, with what it remembers, from task to task."""
    if (key := (kind, *args)) not in _SHARED:
        _SHARED[key] = kind(*args)
    return _SHARED[key]


def load(path: str):
    """The tokenizer of a .json or .model file; one thread each, as Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_batches(parts, most: int):
    """Lists of parts of about `most` bytes; a longer part is alone."""
    held, size = [], 0
    for p in parts:
        n = len(p) if isinstance(p, bytes) or p.isascii() else len(p.encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(p)
        size += n
    if held:
        yield held


def safe_parts(text: str) -> tuple[str, list[str]]:
    """The first part of a text, and those that a space goes before, which is left out.

    A byte-level BPE with the common pattern ` ?letters| ?digits| ?others|space` never merges across these parts: the
    only cut is before a single space between two characters that are no white space, and every alternative of the
    pattern that holds such a space begins with it.
    """
    if _UNSAFE.search(text):
        first, *rest = _CUT.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


def fine_parts(part: str) -> list[str]:
    """Parts of a long part: what the pattern cuts whatever stands before, put together to pieces of about LONG characters.

    Before a single white space that is no space, between characters that are none, the pattern always cuts, and it cuts
    from letters or digits to any other sign but an apostrophe, which may begin a suffix. A run of letters, as in scripts
    without spaces, has no safe boundary inside.
    """
    if len(part) <= LONG:
        return [part]
    out, held = [], ""
    for x in _FINE.splititer(part):
        if held and len(held) + len(x) > LONG:
            out.append(held)
            held = ""
        held += x
    return [*out, held]


class Counter:
    def __init__(self, path: str, batch_bytes: int, half: int) -> None:
        self.tokenizer, self.most, self.memo = load(path), batch_bytes, Memo(half)
        self.splits = not path.endswith(".model")

    def encode(self, parts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.tokenizer.encode(parts, num_threads=1)]
        fine = [fine_parts(p) for p in parts]
        counts = iter([len(x) for x in self.tokenizer.encode_batch_fast([y for x in fine for y in x], add_special_tokens=False)])
        return [sum(next(counts) for _ in x) for x in fine]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [n for b in byte_batches(texts, self.most) for n in self.encode(b)]
        memo, out = self.memo, []
        for group in byte_batches(texts, 4 * self.most):
            cut = [safe_parts(t) for t in group]
            for b in byte_batches(memo.missing(set().union(*[parts for _, parts in cut])), self.most):
                memo.put(b, self.encode([" " + x for x in b]))
            first = [n for b in byte_batches([f for f, _ in cut], self.most) for n in self.encode(b)]
            out += [n + sum(map(memo.new.__getitem__, parts)) for n, (_, parts) in zip(first, cut, strict=True)]
            memo.trim()
        return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 18, memo: int = 48 << 20) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizer's library for the whole text, without added special tokens; special strings
    inside a text are handled as the library does by default. A null text counts as empty: 0 tokens. A text without a
    safe boundary, however long, is encoded as one part. A worker remembers the counts of parts within twice `memo` bytes.
    sentencepiece texts are not cut, as its normaliser looks at
    whole texts. Repeated rows are counted one by one; an empty table gives no rows.
    """

    def run(batches):
        counter = shared(Counter, tokenizer, batch_bytes, memo)
        for b in batches:
            text = b.column("_text")
            size = pa.compute.fill_null(pa.compute.binary_length(text), 0).cast(pa.int64())
            n = np.array(counter.counts([t or "" for t in text.to_pylist()]), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    out = schema(*kept_fields(source, [id_col]), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))
    return source.mapInArrow(run, out)


class WordIds:
    """Ids of whole texts by a word-level BPE that drops white space and marks word ends in its pieces."""

    def __init__(self, path: str, batch: int, half: int, end_id: int = 0) -> None:
        self.tokenizer, self.batch, self.memo = load(path), batch, Memo(half)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.dtype(np.uint16 if max(len(self.ends) - 1, end_id) < 1 << 16 else np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Words of letters only go to the tokenizer as one text, which is cheaper; the ids are cut at word ends."""
        encode = self.tokenizer.encode_batch_fast
        rest = []
        letters = []
        for w in words:
            (letters if w.decode().isalpha() else rest).append(w)
        groups = [letters[i : i + self.batch] for i in range(0, len(letters), self.batch)]
        for group, e in zip(groups, encode([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                data, at = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
                self.memo.put(group, [data[a:b] for a, b in zip([0, *at], at, strict=False)])
            else:  # lower-casing or composing left something that is no letter
                rest += group
        self.memo.put(rest, (np.array(e.ids, self.kind).tobytes() for e in encode([w.decode() for w in rest], add_special_tokens=False)))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text, of 16 bits where the vocabulary and end_id have no larger ones, else of 32.

        Cuts are at ASCII white space, which the tokenizer drops, and between an ASCII letter and most signs. As it lower-cases all, A-Z are folded first, but for what may be a special token.
        """
        memo, out = self.memo, []
        for group in byte_batches(texts, 1 << 20):
            cut = [_MARK.sub(rb" \g<0>", t if b"<|" in t else t.lower()).split() for t in group]
            self.learn(memo.missing(set().union(*cut)))
            out += [b"".join(map(memo.new.__getitem__, words)) for words in cut]
            memo.trim()
        return out
