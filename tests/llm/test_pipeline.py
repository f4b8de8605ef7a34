import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import targets
from tests.llm.test_near import near_roots

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows():
    rng = random.Random(12)
    parts = {"en": "the ing and er tion of th re in at", "fr": "le eau que ment é oi la ou è re", "de": "der sch ein keit ung ü ber ge und ä"}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    out = []
    for i in range(120):
        lang = "en fr de".split()[i % 3]
        out.append((i, text(lang, rng.randrange(30, 160)), lang, f"src{i % 4}" if i % 9 else None))
    out += [(200 + i, out[i][1].replace(" ", "\n", 1) + " ", "en", "src1") for i in range(6)]  # exact copies, longer
    long = text("en", 900)
    out += [(300 + i, long + f" the{i}", "en", "src2") for i in range(5)]  # near copies
    out += [(400, None, "en", "src1"), (401, "", None, "src1"), (402, "123 456 !!", "en", "src1"), (None, text("fr", 50), None, "src0"), (5, out[5][1], "de", "src2"), (5, out[5][1], "de", "src2")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS)
    steps = [sorted(docs.collect(), key=str)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        steps.append(sorted(docs.collect(), key=str))
    start, known, exact, near, mixed, packed = steps
    # 1: texts without letters go, the rest stays
    assert known == [r for r in start if r.text and re.search(r"[^\W\d_]", r.text)]
    # 2: the longest of each text without its white space
    groups = defaultdict(list)
    for r in known:
        groups[SPACE.sub("", r.text)].append(r)
    assert Counter(exact) == Counter(min(g, key=lambda r: (-len(r.text), r.doc_id is None, r.doc_id or 0)) for g in groups.values())
    # 3: one of each component, by smallest id
    best = defaultdict(list)
    for r, root in zip(exact, near_roots([r.text for r in exact]), strict=True):
        best[root].append(r)
    assert Counter(near) == Counter(min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in best.values())
    assert len(near) < len(exact) < len(known) < len(start)
    # 4: words by source meet the targets, and come from the document
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, got = defaultdict(int), defaultdict(int)
    for r in near:
        sizes[r.source] += size(r.text)
    whole = {r.doc_id: r for r in near}
    for r in mixed:
        got[r.source] += size(r.text)
        assert Counter(SPACE.split(r.text.strip())) <= Counter(SPACE.split(whole[r.doc_id].text.strip())) and r.n_chars == len(r.text)
    assert all(abs(got[s] - x) <= 0.51 for s, x in targets(sizes).items())
    # 5: all tokens are packed, and gapless
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert all(n == 2048 for k, n in ends.items() if k < max(ends))


def test_stages_with_clashing_columns_and_two_files(spark, tmp_path):
    made = [(i, r[1], r[2], r[3], r[4], "a", 1, "b", "c") for i, r in enumerate(rows()[:24])] + [(30, "the ing tion " * 20_000, "en", "src0", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    clash = T.StructType([*DOCS.fields, T.StructField("_row", T.StringType()), T.StructField("_metadata", T.IntegerType()), T.StructField("_key", T.StringType()), T.StructField("_pieces", T.StringType())])
    spark.createDataFrame(made, clash).repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == clash.names and docs.count() > 10
    assert {(r._row, r._metadata, r._key, r._pieces) for r in docs.collect()} == {("a", 1, "b", "c"), (None, None, None, None)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, "").count() == 0
