import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessella.llm.packing import packed
from tessella.llm.tokens import WordIds, fine_parts, safe_parts, token_counts

BYTES, WORDS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType())])
ODD = ["", None, " ", "  a", "a  b", "a \n b", "x" * 30_000, "it's we'll 'tis", "a<|endoftext|> b <|startoftext|>c", "\x1c\x1d a\x1fb", "İstanbul ΣΑΣ é   x　y", "日本語 テキスト 12345", "😀 👩‍👩‍👧 ok", "a\tb\r\nc\x0bd\x0c", "end \n", "Stop! Go,now. <|ENDOFTEXT|> A<|endoftext|>B. É, \u0301a .b,", "12 3a4 --- !!\n\n\n  x"]


def rows():
    rng = random.Random(5)
    pool = ["the", "Ünder", "it's", "a,b", "12", "x\n", "", " ", "\t", "<|endoftext|>", "ab" * 9, "§$%", "don't", "ß", "é"]
    made = [" ".join(rng.choice(pool) for _ in range(rng.randrange(400))) for _ in range(40)]
    texts = ODD + made
    return [(i if i != 7 else None, t, ["p", "q", None, "hot", "hot", "hot"][i % 6], "clash") for i, t in enumerate(texts)] + [(3, texts[3], "p", None)]


def test_safe_parts():
    for t in ODD:
        first, rest = safe_parts(t or "")
        assert " ".join([first, *rest]) == (t or "")


def test_counts(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    t = Tokenizer.from_file(BYTES)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows())
    got = token_counts(docs, BYTES, memo=10, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts(spark.createDataFrame([], DOCS), BYTES).collect() == []


def test_counts_of_pieces(spark):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame(rows(), DOCS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts(docs, PIECES).collect()) == sorted((str(i), len(s.encode(x or ""))) for i, x, *_ in rows())


def test_packing(spark):
    t = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    want = sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, *_ in rows() if i != 3)
    got = packed(docs, WORDS, length=256, window_sequences=4, quantum=1, memo=20, carry=["source"]).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[str(r.doc_id)].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in want:
        pieces, at = sorted(by_doc[i], key=lambda r: r.start), 0
        for p in pieces:
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    total = sum(r.length for r in got)
    for k in range(len(by_sequence)):
        at = 0
        for p in sorted(by_sequence[k], key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == min(256, total - 256 * k) > 0
    # every window has the sources' shares
    share, windows = defaultdict(int), -(-total // 1024)
    for r in got:
        share[r.source] += r.length
    for w in range(total // 1024):
        for s in share:
            here = sum(r.length for r in got if r.source == s and r.sequence_id // 4 == w)
            assert abs(here - share[s] / windows) <= 4 * len(share) + share[s] / windows * 0.05 + 1
    assert packed(spark.createDataFrame([], DOCS), WORDS).collect() == []
    # in whole quanta the same ids lie in fewer pieces
    fewer = packed(docs, WORDS, length=256, window_sequences=4, quantum=64, carry=["source"]).collect()
    assert sum(r.length for r in fewer) == total and len(fewer) < len(got)
    ends = defaultdict(int)
    for r in sorted(fewer, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert all(n == 256 for k, n in ends.items() if k < max(ends))


def test_long_texts_without_spaces(spark):
    t = Tokenizer.from_file(BYTES)
    texts = ["".join(f"word{i},line\n" for i in range(3000)), "。".join("文字" * 30 for _ in range(400)), "x" * 30_000, "it's," * 4000, "a\n\nb\t\tc" * 2000]
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, BYTES).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert len(fine_parts(texts[0])) > 5 and "".join(fine_parts(texts[0])) == texts[0]


def test_word_ids():
    """Signs after letters are parts of their own, so that words with them are no new ones; ids are as narrow as they can be."""
    t, w, rng = Tokenizer.from_file(WORDS), WordIds(WORDS, 200, 1 << 16), random.Random(4)
    signs = [*"abAZ019 \n'_-,.!$%&()*+/:;<=>?@[]\\^`{|}~\"#éß日", "\u0301", "İ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2000)]
    got = [np.frombuffer(x, w.kind).tolist() for x in w.ids([x.encode() for x in texts])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    w = WordIds(WORDS, 200, 1 << 16)
    w.ids([b"gate$$$ lamp### gate### lamp$$$ gate--lamp"])
    assert set(w.memo.new) == {b"gate", b"lamp", b"$$$", b"###", b"--lamp"}
    assert w.kind == np.uint16 and WordIds(WORDS, 200, 1 << 16, 1 << 16).kind == np.uint32
