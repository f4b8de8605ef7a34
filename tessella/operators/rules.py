"""The data-quality rules: single-row rules as one Column pass, corpus rules as aggregates and joins.

Findings are rows (rule, level, id, related). A rule runs where the columns that it reads are there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.schema import TYPES, type_spec
from tessella.storage import checkpointed

# Word lists and patterns.
RELATIVE_DATES = ["어제", "지난주", "지난달", "요즘", "이번에", "며칠 전", "얼마 전"]
RECENT = "최근(에|은|까지|부터|이다|이었|이라)"
UNFIXED = ["안 고침", "안고침", "미해결", "나중에 고친다", "나중에 한다", "나중에 본다", "나중으로", "다음 판으로 미룬다", "미룬다"]
QUESTION_TAILS = ["?", "에 대해", "에 관해", "무엇인가", "인가", "일까"]
BUNDLES = [
    "에서 정한 것", "정한 것 (모음|목록)", r"확정\s*(값|—|-|:)", r"[0-9]+\s*(개|가지|건|편|종)(를|을)?\s*(정했다|정한다|골랐다|추렸다|견줘|비교)",
    r"(결정|규칙|항목|후보)\s*[0-9]+\s*(개|건|가지)", r"(다섯|넷|셋|여섯|일곱|여덟|아홉|열)(을|를)?\s*(견줘|비교|골라|정했다)", "목록$",
]
CONCLUSIONS = [
    "(정했다|정한다|못 박|확정|골랐다|택했다|뽑았다)", "(기로 (했다|한다|정했다))", "(쓴다|쓰지 않는다|안 쓴다|만든다|안 만든다|막는다|따른다|남긴다|버린다|삼는다|뺀다|넣는다)",
    "(하지 않는다|안 한다|하면 안 된다|해서는 안 된다|금지)", r"(결론|규칙|원칙)\s*[:：]",
]
GENERIC_TITLES = [
    "정리", "메모", "결정", "기록", "요약", "노트", "내용", "확인", "작업", "할 일", "진행", "정한 것", "잡담", "임시", "테스트", "시험", "todo", "note", "memo",
]
#: A value of four characters or more that has a letter and a digit or sign, and is no number with a unit: not `1200` or `patterns`.
LOOKS_SECRET = r"(?![\d.,]+[A-Za-z%]*[^\sA-Za-z\d]*(?:\s|$))(?=\S*[A-Za-z])(?=\S*[\d!@#$%^&*+~])\S{4,}"
SECRETS = [
    "sk-ant-[A-Za-z0-9_-]{20,}", "sk-(proj|live|test)-[A-Za-z0-9_-]{20,}", "sk-[A-Za-z0-9]{20,}", "ghp_[A-Za-z0-9]{20,}", "github_pat_[A-Za-z0-9_]{20,}", "glpat-[A-Za-z0-9_-]{20,}",
    "xox[baprs]-[A-Za-z0-9-]{10,}", "AKIA[0-9A-Z]{16}", "-----BEGIN [A-Z ]*PRIVATE KEY-----", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"\b\d{6}-[1-4]\d{6}\b",
    r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011)[ -]?\d{4}[ -]?\d{4}[ -]?\d{2,4}\b", r"(?i)\b(password|passwd|pw|token|secret|api[_-]?key)\b\s*[:=]\s*" + LOOKS_SECRET,
    "[A-Za-z0-9+/]{40,}={1,2}", "(?<![A-Za-z0-9+])(?=[A-Za-z0-9+]*[A-Z])(?=[A-Za-z0-9+]*[a-z])(?=[A-Za-z0-9+]*[0-9])[A-Za-z0-9+]{40,}={0,2}",
]
INJECTIONS = [
    r"(?i)(이전|위의|앞의)\s*(지시|명령|규칙)(을|를)?\s*(무시|잊)", r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+instructions", r"(?im)^\s*(system|assistant|human)\s*:",
    "(?i)</?(context|system|instructions)>", r"(?i)여기(까지)?가?\s*자료(다|이다)",
]
PRIVATE_PATH = r"""(?m)(?:^|[\s(\[|>"'`])((?i:[a-z]:\\users\\[^\\\s|]+)|/home/[^/\s|]+|/Users/[^/\s|]+)"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SOURCE = r"^(file|commit|url|note|mem|issue|doc):\S+$"


def any_of(text: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.regexp_like(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


def blank(c: str) -> Column:
    return F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == ""


@dataclass(frozen=True)
class Rule:
    name: str
    level: str
    reads: tuple[str, ...]
    found: Callable[[str], Column]


def _first_line(body: Column) -> Column:
    return F.coalesce(F.try_element_at(X.substantial_lines(body), F.lit(1)), F.lit(""))


def _first_line_weak(_: str) -> Column:
    line = F.btrim(_first_line(F.col("body")))
    ends = F.lit(False)
    for tail in QUESTION_TAILS:
        ends = ends | F.endswith(line, F.lit(tail))
    sentence = F.endswith(line, F.lit(".")) & (F.length(line) >= 10)
    return ((F.length(line) < 20) & ~sentence) | ends


def _echoes(_: str) -> Column:
    text = F.lower(F.concat_ws("\n", "title", "summary", "body"))
    return F.exists("keys", lambda k: F.contains(text, F.lower(k)))


def _no_value(_: str) -> Column:
    head, body = X.grams(X.similarity_normal(F.concat_ws(" ", "title", "summary"))), X.grams(X.similarity_normal(F.col("body")))
    bare = ~F.regexp_like("body", F.lit(r"\d")) & ~F.regexp_like(F.lower("body"), F.lit("[a-z][a-z0-9_./-]{2,}"))
    echo = X.bound(body, lambda b: F.size(F.array_intersect(head, b)) >= 0.9 * F.greatest(F.size(b), F.lit(1)))
    return bare | echo | (F.col("type").isin("decision") & ~any_of(F.col("body"), CONCLUSIONS))


def _summary_apart(_: str) -> Column:
    """Four nouns or more, over half of them missing from the body, and a fifth or fewer backed by it."""

    def absent(low: Column) -> Callable:
        missing = lambda n: F.size(F.filter(n, lambda w: ~X.contains_word(low, w)))
        return lambda n: (F.size(n) >= 4) & (missing(n) * 2 > F.size(n)) & ((F.size(n) - missing(n)) <= 0.2 * F.size(n))

    gap = X.bound(F.lower("body"), lambda low: X.bound(X.noun_words(F.col("summary")), absent(low)))
    return (F.btrim("body") != "") & gap


def _titles_apart(titles: Column) -> Column:
    common = F.aggregate(F.slice(titles, F.lit(2), F.greatest(F.size(titles) - 1, F.lit(0))), F.try_element_at(titles, F.lit(1)), lambda t, x: F.array_intersect(t, x))
    return (F.size(titles) >= 3) & (F.size(common) == 0)


def _section_share(_: str) -> Column:
    return X.bound(F.transform(X.sections(F.col("body")), lambda s: X.words(s["title"])), _titles_apart)


def _generic_title(_: str) -> Column:
    low = F.lower(F.btrim("title"))
    rest = low
    for word in GENERIC_TITLES:
        rest = F.replace(rest, F.lit(word), F.lit(""))
    return (rest != low) & (F.length(F.btrim(rest, F.lit("-·, .:"))) < 2)


def _security_text() -> Column:
    return F.concat_ws("\n", "title", "summary", "body")


ROW_RULES = [
    Rule("F02", "reject", ("id", "type", "summary", "tags", "scope", "created"), lambda _: blank("id") | blank("type") | blank("summary") | blank("scope") | F.col("created").isNull() | (F.coalesce(F.size("tags"), F.lit(0)) <= 0)),
    Rule("F03", "reject", ("note_id",), lambda _: ~F.regexp_like("note_id", F.lit(r"^\d{8}-[0-9a-f]{8}$"))),
    Rule("F04", "reject", ("type",), lambda _: ~F.col("type").isin(*TYPES)),
    Rule("F05", "reject", ("summary",), lambda _: ~F.length("summary").between(30, 120)),
    Rule("F06", "reject", ("title", "summary"), lambda _: ~F.length("title").between(6, 40) | F.startswith(F.col("title"), F.left("summary", F.lit(20)))),
    Rule("F07", "warn", ("title",), _generic_title),
    Rule("F08", "reject", ("tags",), lambda _: ~F.size("tags").between(2, 5)),
    Rule("F09-2", "reject", ("tags",), lambda _: F.exists("tags", lambda t: ~F.regexp_like(t, F.lit(r"^[a-z0-9][a-z0-9-]{0,29}$")))),
    Rule("F14", "reject", ("todo_status", "type"), lambda _: ((F.col("type") == "todo") & ~F.coalesce(F.col("todo_status").isin("open", "doing", "done"), F.lit(False))) | ((F.col("type") != "todo") & (F.coalesce("todo_status", F.lit("")) != ""))),
    Rule("F15", "reject", ("severity", "type"), lambda _: (F.col("type").isin("issue", "caution") & ~F.coalesce(F.col("severity").isin("high", "medium", "low"), F.lit(False))) | (~F.col("type").isin("issue", "caution") & (F.coalesce("severity", F.lit("")) != ""))),
    Rule("F16", "reject", ("sources", "type"), lambda _: (F.coalesce(F.size("sources"), F.lit(0)) <= 0) & F.col("type").isin("issue", "caution", "decision", "fact", "observation")),
    Rule("F16", "warn", ("sources", "type"), lambda _: (F.coalesce(F.size("sources"), F.lit(0)) <= 0) & (F.col("type") == "history")),
    Rule("F17", "reject", ("sources",), lambda _: F.exists("sources", lambda s: ~F.regexp_like(s, F.lit(SOURCE)))),
    Rule("F18", "warn", ("sources",), lambda _: (F.size("sources") > 0) & F.forall("sources", lambda s: F.startswith(s, F.lit("note:")))),
    Rule("F19", "reject", ("author",), lambda _: ~F.regexp_like("author", F.lit(r"^(human|agent|auto)(:[A-Za-z0-9._-]+)?$"))),
    Rule("F20", "reject", ("created",), lambda as_of: F.col("created").isNull() | (F.col("created") > P.day(as_of))),
    Rule("F21", "reject", ("keys",), lambda _: (F.size("keys") > 6) | F.exists("keys", lambda k: ~F.length(k).between(2, 30))),
    Rule("F22", "warn", ("keys", "title", "summary", "body"), _echoes),
    Rule("B01", "reject", ("body",), lambda _: F.size(X.substantial_lines(F.col("body"))) < 3),
    Rule("B02", "warn", ("body",), lambda _: F.size(X.lines(F.col("body"))).between(121, 300)),
    Rule("B03", "warn", ("body",), _first_line_weak),
    Rule("B04", "warn", ("body",), lambda _: F.size(X.headings(F.col("body"))) > 8),
    Rule("B05", "reject", ("body",), lambda _: F.exists(X.sections(F.col("body")), lambda s: F.size(s["lines"]) == 0)),
    Rule("B06", "reject", ("body", "type"), lambda _: (F.col("type") == "issue") & ~_has_section("증상", "해결")),
    Rule("B07", "reject", ("body", "type"), lambda _: (F.col("type") == "howto") & (F.size(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?m)^\s*(\d+)[.)]\s+\S"), F.lit(1)))) < 2)),
    Rule("B08", "warn", ("body", "summary"), _summary_apart),
    Rule("B09", "reject", ("body",), lambda _: any_of(F.col("body"), [*RELATIVE_DATES, RECENT])),
    Rule("B11", "reject", ("body",), lambda _: F.size(X.lines(F.col("body"))) > 300),
    Rule("B12", "warn", ("title", "summary", "body", "type"), _no_value),
    Rule("B13", "reject", ("body", "type", "sources"), lambda _: (F.col("type") == "observation") & F.exists(X.line_cites(F.col("body")), lambda c: (F.size(c) == 0) | (F.size(F.array_except(c, X.mem_sources(F.col("sources")))) > 0))),
    Rule("M01", "warn", ("body",), lambda _: F.size(F.array_distinct(F.transform(X.table_rows(F.col("body")), lambda r: F.try_element_at(r, F.lit(1))))) >= 4),
    Rule("M02", "warn", ("summary",), lambda _: any_of(F.col("summary"), BUNDLES)),
    Rule("M03", "warn", ("body",), _section_share),
    Rule("C07", "reject", ("stale_after",), lambda as_of: F.coalesce(F.col("stale_after") <= P.day(as_of), F.lit(False))),
    Rule("C18", "candidate", ("superseded_by", "invalid_at", "pinned", "state"), lambda as_of: P.is_dead(as_of) & (F.coalesce("state", F.lit("")) != "cold") & ~F.col("pinned")),
    Rule("D06", "candidate", ("sources", "type"), lambda _: F.col("type").isin("issue", "caution", "decision", "fact") & (F.size("sources") > 0) & F.forall("sources", lambda s: F.regexp_like(s, F.lit("^(mem|note):")))),
    Rule("E01", "reject", ("title", "summary", "body"), lambda _: any_of(_security_text(), SECRETS)),
    Rule("E02", "warn", ("body",), lambda _: F.exists(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9+/_-]{20,}"), F.lit(0)), lambda t: F.regexp_like(t, F.lit("[0-9]")) & F.regexp_like(t, F.lit("[A-Z]")) & F.regexp_like(t, F.lit("[a-z]")) & (X.entropy(t) >= 4.0))),
    Rule("E03", "warn", ("title", "summary", "body"), lambda _: any_of(_security_text(), [PRIVATE_PATH])),
    Rule("E05", "warn", ("body",), lambda _: any_of(F.col("body"), INJECTIONS)),
    Rule("X01", "warn", ("content",), lambda _: ~F.is_valid_utf8(F.col("content").cast("string"))),
    Rule("X02", "warn", ("content",), lambda _: F.hex(F.substring("content", 1, 3)) == "EFBBBF"),
    Rule("X03", "warn", ("content",), lambda _: F.contains(F.hex("content"), F.lit("0D0A"))),
]


def _has_section(*names: str) -> Column:
    long = lambda s: (F.size(s["lines"]) >= 2) | (F.length(F.array_join(s["lines"], "")) >= 60)
    every = F.lit(True)
    for n in names:
        every = every & F.exists(X.sections(F.col("body")), _named_section(n, long))
    return every


def _named_section(name: str, long: Callable) -> Callable:
    return lambda s: F.contains(s["title"], F.lit(name)) & long(s)


def row_findings(notes: DataFrame, as_of: str, only: list[str] | None = None) -> DataFrame:
    """(rule, level, id) of all single-row rules in one pass over the notes, without a shuffle."""
    rules = [r for r in ROW_RULES if set(r.reads) <= {*notes.columns} and (only is None or r.name in only)]
    told = [F.when(F.coalesce(r.found(as_of), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"))) for r in rules]
    return notes.select("id", F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("x")).select("x.rule", "x.level", "id")


def not_in_vocabulary(notes: DataFrame, column: str, vocabulary: DataFrame, rule: str) -> DataFrame:
    """tags or scopes that a vocabulary(word) does not have."""
    value = F.explode(column) if dict(notes.dtypes)[column].startswith("array") else F.col(column)
    return notes.select("id", value.alias("word")).join(vocabulary, "word", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("related")).withColumn("rule", F.lit(rule))


def denied_tags(notes: DataFrame, deny: DataFrame) -> DataFrame:
    """(id, related, rule): tags on a deny list(word), which are sources and no topics."""
    hit = notes.select("id", F.explode("tags").alias("word")).join(deny.select(F.lower("word").alias("word")).distinct(), "word", "left_semi")
    return hit.groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("related")).withColumn("rule", F.lit("F10"))


def links_missing(notes: DataFrame, candidates: DataFrame, least: int = 2) -> DataFrame:
    """(id, related): notes without links that have two link candidates(id, other, place) or more."""
    bare = notes.where(F.coalesce(F.size("links"), F.lit(0)) <= 0).select("id") if "links" in notes.columns else notes.select("id")
    found = candidates.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("related"))  # five at most
    return found.where(F.size("related") >= least).join(bare, "id", "left_semi")


def broad_tags(notes: DataFrame, share: float = 0.2, least: int = 20) -> DataFrame:
    """tags on more than a share of all notes."""
    n = notes.agg(F.count("*").alias("n"))
    tags = notes.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("notes"))
    return tags.crossJoin(F.broadcast(n)).where((F.col("n") >= least) & (F.col("notes") > share * F.col("n"))).select("tag", "notes", "n")  # n is one row


def scope_skew(notes: DataFrame, share: float = 0.9, least: int = 20) -> DataFrame:
    """a scope that has more than a share of all notes."""
    n = notes.agg(F.count("*").alias("n"))
    return notes.groupBy("scope").agg(F.count("*").alias("notes")).crossJoin(F.broadcast(n)).where((F.col("n") >= least) & (F.col("notes") > share * F.col("n")))


def stale_age(notes: DataFrame, as_of: str) -> DataFrame:
    """Live notes older than their type's days."""
    spec = F.broadcast(type_spec(notes.sparkSession).select("type", "stale_days"))
    age = F.datediff(P.day(as_of), "created")
    return notes.where(P.is_live(as_of)).join(spec, "type").where((F.col("stale_days") > 0) & (age > F.col("stale_days"))).select("id", "type", age.alias("age"))


def unfixed(notes: DataFrame) -> DataFrame:
    """An unfixed mark while a newer note has a tag of it."""
    tags = notes.select("id", "created", F.explode("tags").alias("tag"), any_of(F.col("body"), UNFIXED).alias("marked"))
    newest = tags.groupBy("tag").agg(F.max(F.struct("created", "id")).alias("newest"))
    marked = tags.where("marked").join(newest, "tag").where(F.struct("created", "id") < F.col("newest"))
    return marked.groupBy("id").agg(F.max("newest").alias("n")).select("id", F.col("n.id").alias("newer"))


def cold(notes: DataFrame, hits: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Old notes without a hit in so many days. hits: (id, at)."""
    last = hits.groupBy("id").agg(F.max("at").alias("last"))
    joined = notes.where(F.datediff(P.day(as_of), "created") > days).join(last, "id", "left")
    return joined.where(F.col("last").isNull() | (F.datediff(P.day(as_of), "last") > days)).select("id", "last")


def orphans(notes: DataFrame, hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes that no hit and no edge mentions."""
    used = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(hits.select("id")).distinct()
    return notes.join(used, "id", "left_anti").select("id")


def dead_links(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to ids that are not in the store."""
    return edges.join(notes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "kind")


def stale_basis(notes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """C14: live notes that cite a dead one, but for the one that superseded it."""
    dead = notes.where(P.is_dead(as_of)).select(F.col("id").alias("dst"), F.col("superseded_by").alias("by"))
    live = notes.where(P.is_live(as_of)).select(F.col("id").alias("src"))
    return edges.join(dead, "dst").where(F.col("by").isNull() | (F.col("by") != F.col("src"))).join(live, "src", "left_semi").select("src", "dst", "kind").distinct()


def cited_not_superseded(notes: DataFrame, edges: DataFrame, as_of: str, change_words: list[str]) -> DataFrame:
    """A newer note of the same scope cites a live one next to a word of change."""
    new = notes.where(any_of(F.col("body"), change_words)).select(F.col("id").alias("src"), F.col("created").alias("when"), F.col("scope").alias("where"))
    old = notes.where(P.is_live(as_of)).select(F.col("id").alias("dst"), "created", "scope")
    return edges.join(new, "src").join(old, "dst").where((F.col("when") > F.col("created")) & (F.col("where") == F.col("scope"))).select("src", "dst").distinct()


def missing_paths(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """File: sources and body links whose target a listing(path) does not have."""
    files = F.transform(F.filter("sources", lambda s: F.startswith(s, F.lit("file:"))), lambda s: F.struct(F.lit("D02").alias("rule"), F.substring(s, F.lit(6), F.length(s)).alias("path")))
    links = F.transform(F.filter(X.body_paths(F.col("body")), lambda p: ~F.contains(p, F.lit(":"))), lambda p: F.struct(F.lit("D05").alias("rule"), p.alias("path")))
    return notes.select("id", F.explode(F.concat(files, links)).alias("x")).select("id", "x.rule", "x.path").join(paths, "path", "left_anti")


def changed_sources(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """File: sources changed more than a day after the note. changes: (path, changed_at)."""
    files = notes.select("id", "created", F.explode(F.filter("sources", lambda s: F.startswith(s, F.lit("file:")))).alias("s")).withColumn("path", F.substring_index("s", "file:", -1))
    return files.join(changes, "path").where(F.col("changed_at") > F.date_add("created", 1)).select("id", "path", "changed_at")


def dead_commits(notes: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit: sources that a list of commits does not have."""
    named = notes.select("id", F.explode(F.filter("sources", lambda s: F.startswith(s, F.lit("commit:")))).alias("s")).select("id", F.substring_index("s", ":", -1).alias("commit"))
    return named.join(commits, "commit", "left_anti")


def redact(text: Column, patterns: list[str] | None = None, mark: str = "[secret]") -> tuple[Column, Column]:
    """The text with matches replaced, and how many there were."""
    count = F.lit(0)
    for p in patterns or SECRETS:
        count = count + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, mark)
    return text, count.cast("long")


#: The review queue of each rule.
QUEUES = {
    "conflict": ("C05", "C13"), "supersede": ("C08", "C16", "C17"), "duplicate": ("C01", "C02", "C03"), "merge": ("C20",), "stale": ("C06", "C07", "C12", "C15"), "basis": ("C14",),
    "contradict": ("C19",), "link": ("D01", "D04"), "path": ("D02", "D03", "D05"), "source": ("D06", "F16", "F18"), "security": ("E01", "E02", "E03", "E05"), "retired": ("C18",), "unfixed": ("B10",),
}
#: A finding is dropped where a stronger one tells of the same pair.
SHADOWS = {"C05": ("C08",), "C17": ("C13",), "C20": ("C13",)}


def review_queues(findings: DataFrame, per_queue: int = 20) -> DataFrame:
    """(kind, place, rule, id): findings by queue, shadowed ones dropped, the first per_queue of each."""
    spark = findings.sparkSession
    findings = checkpointed(findings.select("rule", "id"))  # read three times below; the rules read the texts once
    kinds = F.broadcast(spark.createDataFrame([(k, r) for k, rules in QUEUES.items() for r in rules], "kind string, rule string"))
    shadows = F.broadcast(spark.createDataFrame([(weak, s) for weak, by in SHADOWS.items() for s in by], "rule string, strong string"))
    covered = findings.join(shadows, "rule").join(findings.select(F.col("rule").alias("strong"), "id"), ["strong", "id"], "left_semi").select("rule", "id").distinct()
    kept = findings.join(covered, ["rule", "id"], "left_anti").join(kinds, "rule")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("rule", "id"))
    return kept.withColumn("place", place).where(F.col("place") <= per_queue).select("kind", "place", "rule", "id")


def health(notes: DataFrame, as_of: str) -> DataFrame:
    """One row of health ratios, by one conditional aggregate."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return notes.agg(
        F.count("*").alias("notes"), share(P.is_live(as_of)).alias("live"), share(F.col("pinned")).alias("pinned"),
        share(F.length("summary").between(30, 120)).alias("summary_ok"), share(F.size(X.lines(F.col("body"))) <= 120).alias("body_ok"), share(F.size("tags") >= 2).alias("tags_ok"),
    )
