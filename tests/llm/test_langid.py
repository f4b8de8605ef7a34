import random
import zlib

from pyspark.sql import types as T

from tessella.llm.langid import LETTER, Spectrum, language_id, presence_bits

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("score", T.StringType()))])
PARTS = {"en": "the ing er tion of th re in at", "fr": "le eau que ment é oi la ou è", "de": "der sch ein keit ung ü ber ge und"}


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    rows, truth = [], {}  # truth: the language that a text was made in
    for i in range(400):
        lang = rng.choice(list(PARTS))
        truth[i] = lang
        text = " ".join("".join(rng.choice(PARTS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang if i % 11 else None, "clash"))
    rows += [(1000, None, "en", None), (1001, "", "de", None), (1002, "12 %% 34", "fr", None), (1004, "12 ½ ²", "fr", None), (1005, "① Ⅷ ⁵", None, None), (None, rows[1][1], None, None), (3, rows[3][1], rows[3][2], "x"), (1003, rows[2][1] * 2000, None, None)]
    got = language_id(spark.createDataFrame(rows, DOCS), per_language=80).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002, 1004, 1005):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)
    assert language_id(spark.createDataFrame([], DOCS)).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None, None)], DOCS)
    assert [(r.lang_pred, r.score) for r in language_id(unlabelled).collect()] == [("und", 0.0)]


def test_presence_is_unit():
    s = Spectrum([presence_bits(t) for t in ("abc abc", "abd abc", "xyz")], 100)
    assert (s.of_bits([presence_bits("abd abc")]) == s.presence(["abd abc"])).all()
    x = s.presence(["abc", "", "abd abc"])
    assert abs(float((x[2] ** 2).sum()) - 1) < 1e-5 and float((x[1] ** 2).sum()) == 0


def test_letters_are_those_of_spark(spark):
    signs = [chr(c) for c in (*range(0x80, 0x2FF), 0x2160, 0x2460, 0x3007, 0x3042, 0xAC00, 0x5B57, 0x1D400)]
    told = spark.createDataFrame([(c,) for c in signs], "c string").selectExpr("c", "c rlike '\\\\p{L}' AS letter").collect()
    assert {r.c for r in told if r.letter} == {c for c in signs if LETTER.search(c)}


def test_many_languages_in_two_scans(spark):
    """Every language is learned, however many there are, from its documents of smallest hash."""
    rows = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 4} {'zyxwvutsrqponmlkjihgfedcba'[i % 26] * 3}", f"lang{i % 26:02d}", None) for i in range(1300)]
    got = language_id(spark.createDataFrame(rows, DOCS), per_language=400, most_rows=260, least_rows=4).collect()
    assert all(r.lang_pred == f"lang{r.doc_id % 26:02d}" for r in got)
