import datetime as dt
import gzip
import json
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import fingerprints as H
from tessella.functions import query_text as Q
from tessella.operators import consolidate as C
from tessella.operators import duplicates as D
from tessella.operators import evaluate as E
from tessella.operators import lookup as L
from tessella.operators import reports as R
from tessella.operators import sinks as S
from tessella.operators import vectors as V
from tessella.operators import vocabulary as W
from tessella.sources import stores
from tessella.streaming import events, inbox

DAY = dt.date(2025, 2, 1)


def test_query_text():
    known = {"검색", "색인", "검색색", "인덱스", "기억"}.__contains__
    assert [(r.text, r.kind) for r in Q.runs("unity빌드x")] == [("unity", "en"), ("빌드", "ko")] and [(r.text, r.kind) for r in Q.runs("훅")] == [("훅", "ko1")]
    assert Q.ask_for(Q.Run("빌드판", "ko")) == Q.Ask(("빌드", "드판")) and Q.term_asks("훅")[0] == Q.Ask(prefix="훅", fields=Q.HEAD)
    assert Q.phrase_ask("The 빌드판 x") == Q.Ask(("the", "빌드", "드판", "x")) and Q.prefix_ask("Abc") == Q.Ask(prefix="abc") and Q.one_letter_ask("훅") == Q.Ask(prefix="훅") and Q.one_letter_ask("x") is None
    assert Q.split_pairs("검색색인", known) == [("검색", "색인")] and Q.split_vocabulary("검색색인기억", known) == [("검색", "색인", "기억")] and Q.known_prefix("검색색인", known) == "검색색"
    assert Q.extras("camelCase-5,000") == ["camelcase", "5", "000", "camel", "case", "camelcase-5000"] and Q.plain_number("x5,000y") == "x5000y" and Q.like_escape("50%_\\") == "50\\%\\_\\\\"
    assert Q.both_ways({"a": ["b"], "c": ["b"]}) == {"a": ["b"], "b": ["a", "c"], "c": ["b"]} and Q.scope_for({"App": "core"}, "/x/app/") == "core" and Q.scope_for({}, "C:\\Y\\Zed") == "zed"
    assert Q.since_date("30d", "2025-02-10") == "2025-01-11" and Q.since_date("2024-02-30", "2025-02-10") is None and Q.jamo("가x") == "\u1100\u1161x" and Q.despace("a b") == "ab" and Q.glued_ask("A1") == Q.Ask(("a1",))


def fnv(data):
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_fingerprints():
    for text in ("", "ab", "abc", "한국어 text", "𝒳yz é", "abcabc"):
        grams = [" ".join(text.split())[i : i + 3] for i in range(len(" ".join(text.split())) - 2)]
        want = sum(1 << i for i in range(64) if 2 * sum(fnv(g.encode()) >> i & 1 for g in grams) > len(grams))
        assert np.uint64(H.simhash_of(text) & 2**64 - 1) == np.uint64(want)
        runes = sorted({fnv(map(ord, text[i : i + 3])) for i in range(max(1, len(text) - 2))}) if text else []
        assert H.gram_hashes(text).tolist() == runes


def some_notes(n=60):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        base = out[i - 1][4] if i % 4 == 1 else ". ".join(" ".join(rng.choice(words) for _ in range(9)) + f" {rng.randrange(50)}" for _ in range(5))
        body = base.replace(rng.choice(words), "덮 바꾼") if i % 8 == 5 else base
        out.append((i, ["fact", "decision", "history", "howto"][i % 7 % 4], f"title {i % 9}", body[:80], body, ["en", f"t{i % 5}"], f"s{i % 2}", DAY - dt.timedelta(days=i % 20), None, None, i % 9 == 0))
    return out


NOTE = "id long, type string, title string, summary string, body string, tags array<string>, scope string, created date, superseded_by long, invalid_at date, pinned boolean"


def test_duplicates_against_brute_force(spark):
    rows = some_notes()
    notes = spark.createDataFrame(rows, NOTE)
    made = {r[0]: D.Note(r[2], r[3], r[4], r[5], r[6]) for r in rows}
    prints = {i: (H.simhash_of(f"{D.normal(f'{r[3]} {r[2]}')} {n.body}"), H.simhash_of(D.normal(f"{r[3]} {r[2]}"))) for r in rows for i, n in [(r[0], made[r[0]])]}
    band = lambda x: [(b, (x >> 16 * b) & 65535) for b in range(4)]
    want = {}
    for i in made:
        found = []
        for j in made:
            a, b = made[i], made[j]
            narrow = bool(set(band(prints[i][0])) & set(band(prints[j][0]))) or bool(a.tags & b.tags) or a.scope == b.scope
            sketched = bool(a.units.sketches() & b.units.sketches())
            if i != j and (narrow or sketched or set(band(prints[i][1])) & set(band(prints[j][1]))):
                found.append((not sketched, -len(a.tags & b.tags), ((prints[i][0] ^ prints[j][0]) & 2**64 - 1).bit_count(), j, narrow, sketched))
        for _, _, _, j, narrow, sketched in sorted(found)[: D.PER_NOTE]:
            a, b = made[i], made[j]
            # unit alignment by plain sets
            sets = [[{u[k : k + 3] for k in range(len(u) - 2)} for u in map(D.normal, n.units.texts)] for n in (a, b)]
            best = max((len(x & y) / len(x | y) for x in sets[0] for y in sets[1]), default=0)
            want[i, j] = (narrow, sketched, round(a.score(b), 9), round(best, 9))
    got = {(r.left, r.right): r for r in D.compared(notes).collect()}
    marked = {(r.left, r.right): (r.narrow, r.sketched) for r in D.candidates(notes).collect()}
    assert set(got) == set(want) == set(marked) and all(marked[k] == v[:2] and got[k].raw == v[2] for k, v in want.items())
    assert all(got[k].best <= v[3] + 1e-9 for k, v in want.items()) and sum(abs(got[k].best - v[3]) < 1e-9 for k, v in want.items() if v[3] >= 0.3) > 20
    found = {(r.rule, r.id) for r in D.store_findings(notes, "2025-02-10").collect()}
    assert {r for r, _ in found} >= {"C01", "C03", "C05", "C08"} or {r for r, _ in found} >= {"C02", "C03", "C05", "C08"}
    assert D.store_findings(spark.createDataFrame([], NOTE), "2025-02-10").collect() == []
    split = notes.withColumn("title", F.lit("two words")).withColumn("sources", F.array(F.lit("file:a.md#1"))).where("id IN (0, 9)").withColumn("type", F.lit("fact")).withColumn("scope", F.lit("s"))
    assert D.split_pairs(split.withColumn("created", F.lit(DAY)), "2025-02-10").count() == 1


def test_lookup(spark):
    notes = spark.createDataFrame(some_notes(), NOTE)
    edges = spark.createDataFrame([(1, 2, "link"), (3, 99, "link")], "src long, dst long, kind string")
    assert [r.id for r in L.link_targets(notes, edges, notes).collect()] == [2] and L.link_pairs(edges, notes).count() == 1 and [r.id for r in L.linked_to(edges, notes, 2).collect()] == [1]
    assert L.by_id(notes, 7).count() == 1 and L.recent(notes, "fact", 3).count() == 3 and L.ages(notes, "2025-02-10", 20).first().total == 60
    assert L.split_held(notes.where("id < 5"), notes.where("id < 2")).first() == (5, 2)
    scores = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 1, 0.8), (1, 3, 0.8)], "left int, right int, score double")
    assert [(r.left, r.right) for r in L.mutual_nearest(scores).collect()] == [(1, 2)]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), f"h{i}") for i in range(40)]
    v = spark.createDataFrame(rows, "id long, v array<double>, hash string")
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = m @ m.T - 2 * np.eye(40)
    got = {(r.id, r.place): r.other for r in V.nearest(v, 8, 2, least=-1).collect()}
    assert all(got[i, 1] == int(cos[i].argmax()) for i in range(40))
    near = V.stored(v, "r1")
    assert max(abs(a - b) for r in V.loaded(near).collect() for a, b in zip(r.v, rows[r.id][1], strict=True)) < 0.03
    notes = spark.createDataFrame([(i, f"h{i}" if i else "new", f"t{i}") for i in range(41)], "id long, hash string, text string")
    made = V.rebuilt(notes, near, lambda texts: [[float(len(t))] * 8 for t in texts], F.col("text"), "r1")
    assert made.count() == 41 and {r.id for r in V.stale(notes, near, "r1").collect()} == {0, 40} and V.stale(notes, made, "r1").count() == 0
    table = spark.createDataFrame([("a", 1.0, [1.0, 0.0]), ("b", 2.0, [0.0, 1.0])], "term string, weight double, v array<double>")
    doc = spark.createDataFrame([(1, ["a"], ["b", "b"])], "id int, title array<string>, body array<string>")
    assert [round(x, 6) for x in V.static_vectors(doc, table, {"title": F.col("title"), "body": F.col("body")}).first().v] == [0.894427, 0.447214]
    fused = spark.createDataFrame([(i, 1.0 - i / 100) for i in range(6)], "id long, rrf double")
    assert V.flat(fused).first().flat and not V.flat(fused.where("id < 3")).first().flat
    lifted = V.blended(fused, V.cosine_list(fused, v, rows[3][1])).orderBy(F.desc("rrf")).first()
    assert lifted.id == 3
    assert (V.hyperplanes(8) == V.hyperplanes(8)).all() and V.remixed(fused, V.cosine_list(fused, v, rows[5][1]), 0.0).orderBy(F.desc("rrf")).first().id == 5


def test_consolidation(spark):
    rows = [(i, "fact", "t", "s", "b", ["x"], "s", DAY, None if i not in (20, 21) else i + 1, None, False) for i in range(30)]
    notes = spark.createDataFrame(rows, NOTE).withColumn("origin", F.when(F.col("id") < 2, "auto"))
    edges = spark.createDataFrame([(0, 1, "link"), (1, 2, "link"), (5, 6, "link")], "src long, dst long, kind string")
    groups = C.link_groups(notes, edges, "2025-02-10")
    assert sorted((r.group, r.id) for r in groups.collect()) == [(0, 0), (0, 1), (0, 2)]
    assert sorted((r.group, r.id) for r in C.admitted(groups, notes).collect()) == [(0, 2)]
    assert sorted((r.group, r.id, r.hops) for r in C.chain_groups(notes).collect()) == [(22, 20, 2), (22, 21, 1), (22, 22, 0)]
    vectors = spark.createDataFrame([(i, [1.0, 0.01 * i] if i < 4 else [-1.0, float(i)]) for i in range(8)], "id long, v array<double>")
    assert {r.id for r in C.meaning_groups(notes.where("id < 8"), vectors, "2025-02-10").collect() if r.group == 0} == {0, 1, 2, 3}
    cards = spark.createDataFrame([("c1", [0, 1, 2]), ("c2", [5, 6, 7, 8])], "card string, basis array<long>")
    more = spark.createDataFrame([("g1", 0), ("g1", 1), ("g1", 2), ("g2", 5), ("g2", 6), ("g2", 7), ("g3", 9)], "group string, id long")
    assert {(r.group, r.what, r.card) for r in C.plan(more, cards).collect()} == {("g1", "same", "c1"), ("g2", "again", "c2"), ("g3", "new", None)}
    assert C.found([groups, groups]).select("group").distinct().count() == 1


def test_sinks_and_inbox(spark, tmp_path):
    rows = [(str(r[0]), *r[1:8], None, None, r[10]) for r in some_notes(6)]
    notes = spark.createDataFrame(rows, NOTE.replace("id long", "id string").replace("superseded_by long", "superseded_by string")).withColumn("keys", F.lit(None).cast("array<string>")).withColumn("importance", F.lit(3)).withColumn("severity", F.lit(None).cast("string")).withColumn("todo_status", F.lit(None).cast("string"))
    store = str(tmp_path / "store")
    inbox.begin(notes.withColumn("sources", F.array().cast("array<string>")).withColumn("links", F.array().cast("array<string>")), store)
    (tmp_path / "in").mkdir()
    first = notes.orderBy("id").first()

    def ask(name, **fields):
        (tmp_path / "in" / name).write_text(json.dumps({"at": "2025-02-09T00:00:00Z", **fields}))

    ask("a.json", op="add", id="n1", type="fact", title="a new thing", summary="s", body="brand new", tags=["q"], scope="s0")
    ask("b.json", op="add", id="n2", type="fact", title="a new thing", summary="s", body="brand new", tags=["q"], scope="s0")  # the same again
    ask("c.json", op="add", id="n3", type=first.type, title="x", summary="s", body=first.body, tags=[], scope=first.scope)  # an exact twin
    ask("d.json", op="patch", target="n2", fields={"title": "patched", "body": "not allowed"})  # of a note that was merged away
    ask("e.json", op="body", target="1", body="replaced")
    (tmp_path / "in" / "f.json").write_text("{oops")
    for _ in range(2):
        inbox.run(spark, str(tmp_path / "in"), store, str(tmp_path / "check"), "2025-02-10")
    got = {r.id: r for r in S.published(spark, store, "notes").collect()}
    assert set(got) == {*(str(i) for i in range(6)), "n1"} and got["n1"].title == "patched" and got["n1"].body == "brand new" and got["1"].body == "replaced"
    assert [r.name for r in spark.read.json(f"{store}/rejected").collect()] == ["f.json"] and spark.read.parquet(f"{store}/archive").count() == 1
    # the same files under another checkpoint are a replay: keys are known
    inbox.run(spark, str(tmp_path / "in"), store, str(tmp_path / "again"), "2025-02-10")
    assert S.published(spark, store, "notes").count() == 7
    queue = spark.createDataFrame([("s1", "t1", None, None, None), ("s2", "t2", None, None, None)], "session_id string, at string, done_at string, result string, saved array<string>")
    marks = spark.createDataFrame([("s1", "t1", "d", "ok", ["x"]), ("s2", "old", "d", "ok", ["x"])], "session_id string, picked_at string, done_at string, result string, saved array<string>")
    assert {r.session_id: r.result for r in S.mark_done(queue, marks).collect()} == {"s1": "ok", "s2": None}


def test_stores(spark, tmp_path):
    member = lambda *ids: gzip.compress("".join(json.dumps({"op": "cold", "id": i, "markdown": "m"}) + "\n" for i in ids).encode())
    (tmp_path / "a.jsonl.gz").write_bytes(member("1", "2") + member("3") + member("4", "5")[:-12])
    assert {"1", "2", "3"} <= {r.id for r in stores.archive(spark, str(tmp_path)).collect()}
    data = b"one\ntwo\nthr"
    files = spark.createDataFrame([("p", bytearray(data)), ("q", bytearray(b"short\n"))], "path string, content binary")
    at = spark.createDataFrame([("p", 4), ("q", 100)], "path string, offset long")
    assert {(r.path, r.offset, r.line) for r in stores.tail(files, at).collect()} == {("p", 8, "two"), ("q", 6, "short")}
    assert [r.line for r in stores.endings(files.where("path = 'p'"), 6).collect()] == ["thr"]
    talk = [{"message": {"role": "user", "content": "hi"}}, {"isMeta": True, "message": {"role": "user", "content": "no"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}, {"type": "tool"}]}}]
    lines = spark.createDataFrame([("p", n, json.dumps(t)) for n, t in enumerate(talk)], "path string, line_no long, line string")
    assert [(r.role, r.text) for r in stores.utterances(lines).orderBy("turn").collect()] == [("user", "hi"), ("assistant", "yes")]
    cases = stores.golden(spark, [{"q": "x", "expect": ["1", "2"], "expect_mode": "all"}, {"q": "y", "kind": "abstain"}])
    got = spark.createDataFrame([("0", "1", 1, True), ("0", "2", 7, True)], "case string, id string, rank int, strict boolean")
    assert {r.case: r.rank for r in E.ranks_by_mode(cases, got).collect()} == {"0": 7, "1": None} and E.abstention(cases, got).first().abstain == 1.0
    golden = stores.quality_golden(spark, {"flag": [{"id": 1, "defects": ["DUP"], "rules": ["C01"]}], "clean": [{"id": 2, "allow_rules": ["F05"]}]})
    fired = spark.createDataFrame([(1, "C01"), (2, "F05"), (2, "B01")], "id int, rule string")
    assert E.defect_scores(golden, fired).first().recall == 1.0 and E.false_alarms(golden, fired).first().rules == ["B01"]


def test_vocabulary_and_reports(spark):
    v = W.parse(spark, '[tags.search]\naliases = ["find"]\nchildren = ["ranking"]\n[scopes.core]\naliases = ["kernel"]\n')
    words = spark.createDataFrame([("Find ",), ("other",)], "word string")
    assert [(r.canonical, r.standard, r.changed) for r in W.normalised(words, v, "tag").orderBy("canonical").collect()] == [("other", False, False), ("search", True, True)]
    assert [r.tag for r in W.standard_tags(v).collect()] == ["ranking", "search"] and W.parents(v).first() == ("ranking", "search")
    near = W.near_tags(spark.createDataFrame([("serch",), ("zzz",)], "tag string"), W.standard_tags(v)).collect()
    assert [(r.tag, r.near, r.distance) for r in near] == [("serch", "search", 1)]
    assert R.allocate(10, [50, 30, 20], [2, 9, 9]) == [2, 6, 2] and R.claims("| 결정 | x |\n|---|---|\n| a | b |\n- 정함: c\nnotes add --summary \"d\"") == ["a", "c", "d"]
    hits = spark.createDataFrame([(i, i, "# t", "s <b>", 1.0) for i in range(1, 6)], "place int, id int, title string, summary string, score double")
    assert R.rendered(hits, 9).count() in (1, 2) and R.rendered(hits, 1000).count() == 5
    block = spark.createDataFrame([("b", "x", 1, "word " * 20), ("b", "x", 2, "word " * 20), ("b", "keep", 1, "word " * 30)], "block string, section string, place int, line string")
    assert [(r.section, r.place) for r in R.shrunk(block, 80, ["keep"]).collect()] == [("keep", 1), ("x", 1)]
    log = spark.createDataFrame([("alpha beta",), ("alpha",)], "query string")
    assert [(r.word, r.n) for r in W.missed_words(log, 2).collect()] == [("alpha", 2)]


def test_sessions(spark):
    now = "2025-02-10 12:00:00"
    q = spark.createDataFrame([("s1", "p1", "end"), ("s2", "p2", "compact")], "session_id string, transcript_path string, reason string")
    f = spark.createDataFrame([("p1", "2025-02-10 11:30:00"), ("p2", "2025-02-10 11:30:00")], "path string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    assert {r.session_id: r.live for r in events.still_active(q, f, now).collect()} == {"s1": False, "s2": True}
    assert events.too_soon("2025-02-10T01:00:00", "2025-02-10T12:00:00") and not events.too_soon(None, "2025-02-10T12:00:00")
