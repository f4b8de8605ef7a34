import random

from pyspark.sql import types as T

from tessella.llm.lines import line_dedup, without_lines
from tests.llm.test_near import rows_made

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("line_no", T.StringType()), ("n", T.StringType()))])


def near_lines(a, b):
    """One token edited, and what is left of both has four fifths of either's characters."""
    size = lambda w: len(" ".join(w))
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    for i in range(len(a)):
        rest = a[:i] + a[i + 1 :]
        other = b[:i] + b[i + 1 :] if len(a) == len(b) else b
        if rest and rest == other and 5 * size(rest) >= 4 * max(size(a), size(b)):
            return True
    return False


def brute(rows):
    import re

    split = lambda t: [tuple(w for w in re.split(r"[\x20\x09-\x0d]+", x) if w) for x in (t or "").split("\n")]
    tokens = lambda w: tuple("".join(w)) if len(" ".join(w).encode()) > 2 * len(" ".join(w)) else w
    order = sorted(((i is None, i or 0, k, no, w) for k, (i, t, *_) in enumerate(rows) for no, w in enumerate(split(t)) if w))
    first = {}
    for n, (*_, w) in enumerate(order):
        first.setdefault(w, n)
    near = {w for w, n in first.items() for v, m in first.items() if m < n and (tokens(v) == tokens(w) or near_lines(tokens(v), tokens(w)))}
    out = {k: [len(split(t)), 0, 0, []] for k, (_, t, *_) in enumerate(rows)}
    for n, (_, _, k, no, w) in enumerate(order):
        if first[w] < n:
            out[k][1] += 1
        elif w in near:
            out[k][2] += 1
        else:
            continue
        out[k][3].append(no)
    return sorted((str(rows[k][0]), a, b, c, ",".join(map(str, d))) for k, (a, b, c, d) in out.items())


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split())
    pool = [[word() for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    for base in list(pool):
        for _ in range(4):
            w, at = list(base), rng.randrange(len(base))
            kind = rng.randrange(4)
            w[at : at + (kind != 0)] = [] if kind == 1 else [word()] if kind < 3 else w[at : at + 1]
            pool.append(w)
    pool += [["page", str(i), "of", "the", "same", "book"] for i in range(60)] + [["internationalization", *w, "documentation"] for w in ([], ["of"], ["and"], ["for", "a"])]
    for _ in range(12):  # a script without spaces
        base = [rng.choice("的一是不了人我在有他") for _ in range(12)]
        pool += [["".join(base)], ["".join(base[:5]), "".join(base[5:])], ["".join(base[:7]), "".join(base[8:])], ["".join(base[:3] + ["大"] + base[4:])], ["".join(base[:3])]]
    join = lambda w: rng.choice([" ", " ", " ", "  ", "\t"]).join(w) + rng.choice(["", "", " ", "\r"])
    rows = [(i, "\n".join(join(rng.choice(pool)) for _ in range(rng.randrange(0, 9))), "clash", "clash") for i in range(90)]
    rows += [(200, None, "x", "x"), (201, "", "x", "x"), (None, rows[3][1], "x", "x"), (202, "\n\n", "x", "x"), (203, "long " * 5000, "x", "x"), (4, rows[4][1], "x", "x")]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = sorted((str(r[0]), *r[1:]) for r in line_dedup(docs).collect())
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 20
    assert line_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_apply(spark):
    rows = [(1, "a b c d e f\nshort\na b c d e g", None, None), (2, "x\na b c d e f", None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.text for r in without_lines(docs, line_dedup(docs)).collect()}
    assert got == {1: "a b c d e f\nshort", 2: "x", 3: None}


def test_only_documents_with_suspects_are_cut_again(spark):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(5)) for _ in range(400)]
    texts += ["a b c d e f g h", "a b c d e f g x"]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    made, got = rows_made(spark, "posexplode", lambda: line_dedup(docs).collect())
    assert [r.doc_id for r in got if r.dropped] == [401]
    assert 2002 <= sum(made) < 1.5 * 2002
