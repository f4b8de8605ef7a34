"""String functions as Columns: tokens, normal forms, grams, facts, budgets, sanitising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{Nd}]+"
#: Particles that are tried in this order.
PARTICLES = ["으로", "에서", "에게", "한테", "보다", "까지", "부터", "을", "를", "이", "가", "은", "는", "의", "로", "와", "과", "도", "만", "에"]
CJK = r"[\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def words(text: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters and digits, of `least` characters or more."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: F.length(w) >= least)


def bound(value: Column, then) -> Column:
    """then(value), with value worked out once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _chars(text: Column, n: int, finish) -> Column:
    """All runs of n neighbouring characters, or the text itself if it is shorter; none of an empty text."""

    def runs(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0)))
        return finish(F.transform(starts, lambda i: F.concat_ws("", *[F.get(c, i + k) for k in range(n)])))

    return F.when(F.length(text) > 0, bound(F.filter(F.split(text, "", -1), lambda x: x != ""), runs)).otherwise(F.array().cast("array<string>"))


def bigrams(run: Column) -> Column:
    """Character pairs of a run; one character stays alone, none gives none."""
    return _chars(run, 2, lambda x: x)


def hangul_tokens(text: Column) -> Column:
    """Index tokens: Hangul runs as bigrams, other runs of letters and digits whole."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[가-힣]+|[^\P{L}가-힣]+|\p{Nd}+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(F.regexp_like(r, F.lit("^[가-힣]")), bigrams(r)).otherwise(F.array(r))))


def index_tokens(text: Column) -> Column:
    """Words, but with each Hangul run of a word as its bigrams and what is around it as words of their own."""
    plain = words(text)
    split = F.flatten(F.transform(plain, lambda w: F.when(F.regexp_like(w, F.lit("[가-힣]")), hangul_tokens(w)).otherwise(F.array(w))))
    return F.when(F.regexp_like(text, F.lit("[가-힣]")), split).otherwise(plain)


def number_plain(word: Column) -> Column:
    """5,000 as 5000: commas of well-grouped numbers go."""
    return F.when(F.regexp_like(word, F.lit(r"^\d{1,3}(,\d{3})+$")), F.replace(word, F.lit(","))).otherwise(word)


def camel_parts(word: Column) -> Column:
    """Parts that begin at capitals, lower-cased."""
    marked = F.regexp_replace(word, r"(\p{Lu})", "\u0001$1")
    return F.filter(F.split(F.lower(marked), "\u0001"), lambda p: p != "")


def symbol_parts(word: Column) -> Column:
    return F.filter(F.split(F.lower(word), NOT_WORD), lambda p: p != "")


def strip_particle(word: Column) -> Column:
    """A Hangul word without its particle, if a stem of two characters or more stays."""
    tries = [F.when(F.regexp_like(word, F.lit(f"^[가-힣]{{2,}}{p}$")), F.left(word, F.length(word) - len(p))) for p in PARTICLES]
    return F.coalesce(*tries, word)


def despace(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def half_width(text: Column) -> Column:
    """Full-width forms of ASCII, and the wide space, as their usual forms."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(text, wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def base_normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(half_width(text)), r"\s+", " "))


def canonical(text: Column, table: dict[str, str]) -> Column:
    """Longest-match replacement by a small table; keys that begin or end with ASCII letters or digits match whole words only."""
    import re

    def pattern(key: str) -> str:
        left = r"(?<![A-Za-z0-9])" if re.match(r"[A-Za-z0-9]", key) else ""
        right = r"(?![A-Za-z0-9])" if re.search(r"[A-Za-z0-9]$", key) else ""
        return left + "".join(c if c.isalnum() else "\\" + c for c in key) + right

    return reduce(lambda t, k: F.regexp_replace(t, pattern(k), table[k].replace("\\", "\\\\").replace("$", "\\$")), sorted(table, key=lambda k: (-len(k), k)), text)


def check_canon(table: dict[str, str]) -> None:
    """No empty sides, and no target that is a key itself."""
    if any(not k or not v for k, v in table.items()) or set(table) & set(table.values()):
        raise ValueError("empty or chained canonical mapping")


def similarity_normal(text: Column) -> Column:
    """Lower case, digit-group commas gone, then letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(\d),(\d{3})", "$1$2"), NOT_WORD, "")


def grams(normal: Column, n: int = 3) -> Column:
    """Sorted distinct character n-grams; a shorter text is one gram, an empty one has none."""
    return _chars(normal, n, lambda x: F.sort_array(F.array_distinct(x)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones have none in common."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > common, common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def content_words(text: Column) -> Column:
    """Hangul words of two characters, Latin and digit words of three or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[가-힣]+|[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= F.when(F.regexp_like(w, F.lit("^[가-힣]")), 2).otherwise(3))


#: Tails of nouns, and tails of predicates, that are tried in this order.
NOUN_TAILS = [
    "에서는", "에게는", "에서", "에게", "까지", "부터", "으로", "보다", "처럼", "마다", "만큼", "이라", "라는", "라고", "이는", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "만",
]
PREDICATE_TAILS = ["였다", "었다", "겠다", "한다", "된다", "이다", "않다", "린다", "든다", "난다", "간다", "온다", "본다", "쓴다", "묻다", "다"]


def noun_words(text: Column) -> Column:
    """Content words without particles; Hangul words that are a particle or end like a predicate are none."""
    hangul = lambda w: F.regexp_like(w, F.lit("^[가-힣]"))
    predicate = lambda w: F.regexp_like(w, F.lit(f"^.+(?:{'|'.join(PREDICATE_TAILS)})$"))

    def bare(w: Column) -> Column:
        return F.coalesce(*[F.when(hangul(w) & F.endswith(w, F.lit(t)) & (F.length(w) >= len(t) + 2), F.left(w, F.length(w) - len(t))) for t in NOUN_TAILS], w)

    return F.transform(F.filter(content_words(text), lambda w: ~(hangul(w) & (w.isin(*NOUN_TAILS) | predicate(w)))), bare)


def contains_word(body: Column, word: Column) -> Column:
    """The word itself, or for three letters and more at least half of its letter pairs, is in the body."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))
    some = F.size(F.filter(pairs, lambda p: F.contains(body, p))) * 2 >= F.length(word) - 1
    return F.contains(body, word) | ((F.length(word) >= 3) & some)


def lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def headings(body: Column) -> Column:
    return F.filter(lines(body), lambda x: F.startswith(F.btrim(x), F.lit("##")))


def substantial_lines(body: Column) -> Column:
    return F.filter(lines(body), lambda x: (F.btrim(x) != "") & ~F.startswith(F.btrim(x), F.lit("#")))


def sections(body: Column) -> Column:
    """array<struct<title, lines>>: the substantial lines below each ## heading."""
    parts = F.split(F.concat(F.lit("\n"), body), r"\n[ \t]*#{2,}", -1)
    rest = lambda p: F.split(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p)), "\n", -1)
    solid = lambda x: (F.btrim(x) != "") & ~F.startswith(F.btrim(x), F.lit("#"))
    return F.transform(
        F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.btrim(F.substring_index(p, "\n", 1)).alias("title"), F.transform(F.filter(rest(p), solid), lambda x: F.btrim(x)).alias("lines"))
    )


def table_rows(body: Column) -> Column:
    """Cells of table lines, without divider rows."""
    rows = F.filter(lines(body), lambda x: F.regexp_like(x, F.lit(r"^\s*\|.*\|\s*$")) & ~F.regexp_like(x, F.lit(r"^\s*\|[\s:|-]+\|\s*$")))
    return F.transform(rows, lambda x: F.transform(F.split(F.btrim(F.btrim(x), F.lit("|")), r"\|"), lambda c: F.btrim(c)))


def units(text: Column) -> Column:
    """Sentences, table rows and list rows, without their lead marks."""
    flat = F.flatten(F.transform(lines(text), lambda x: F.split(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("|"), F.lit(" ")), r"^[\s#>*+-]+", ""), r"\.(?:[ \t]|$)", "\u0001"), "\u0001")))
    return F.filter(F.transform(flat, lambda u: F.btrim(u)), lambda u: u != "")


def facts(text: Column) -> Column:
    """struct of sorted distinct numbers and Latin names of three characters or more."""
    low = F.lower(text)
    find = lambda p: F.sort_array(F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(0))))
    return F.struct(find(r"\d[\d.]*").alias("numbers"), find(r"[a-z][a-z0-9_./-]{2,}").alias("names"))


def clash(a: Column, b: Column) -> Column:
    """Both sides have facts that the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def body_paths(body: Column) -> Column:
    """Targets of Markdown links."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\]\(([^)\s#]+)"), F.lit(1)))


def _of_kind(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def fragments(text: Column) -> Column:
    """array<struct<kind, value>> of urls, ids, dates, paths and numbers, each found in what the kinds before have left."""
    kinds = [
        ("url", r"https?://[^\s<>]+"), ("id", r"\b\d{8}-[0-9a-f]{8}\b"), ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
        ("path", r"[A-Za-z0-9_.-]*/[A-Za-z0-9_./-]+"), ("number", r"\d[\d.,]*\d|\d"),
    ]
    rest, out = text, []
    for kind, pattern in kinds:
        out.append(F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), _of_kind(kind)))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.concat(*out)


def fold(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(F.lower(text), F.lit("\\"), F.lit("/")), r"\s+", " "))


def clean_talk(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", " ")


def one_line(text: Column) -> Column:
    """Format and control characters out, white space to single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cf}]", ""), r"[\s\p{Cc}]+", " "))


def neutralize(text: Column) -> Column:
    """Markup characters as look-alikes, lead marks of lists and headings gone."""
    return F.regexp_replace(F.translate(text, "<>`[]{}", "‹›'()()"), r"(?m)^[ \t]*[#>*+-]+[ \t]*", "")


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """ceil((0.6 per CJK character + 0.25 per other) x 1.2), in whole hundredths so that no rounding error shows."""
    wide = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    hundredths = wide * 72 + (F.length(text) - wide) * 30
    return F.ceil(hundredths / 100).cast("long")


def within_budget(text: Column, limit: int) -> Column:
    """The longest prefix whose estimate is within the limit, found by halving.

    A character counts 0.3 at least, so that only the first limit / 0.3 characters are looked at, however long the text.
    """
    if limit <= 0:
        return text
    most = limit * 100 // 30
    head = F.left(text, F.lit(most + 1))
    middle = lambda s: ((s["lo"] + s["hi"] + 1) / 2).cast("int")

    def found(head: Column) -> Column:
        step = lambda s, _: F.when(
            token_estimate(F.left(head, middle(s))) <= limit, F.struct(middle(s).alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), F.greatest(s["lo"], middle(s) - 1).alias("hi")))
        start = F.struct(F.lit(0).alias("lo"), F.least(F.length(head), F.lit(most)).alias("hi"))
        return F.left(head, F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), start, step)["lo"])

    return F.when((F.length(text) <= most) & (token_estimate(head) <= limit), text).otherwise(bound(head, found))


def source_kind(source: Column) -> Column:
    return F.when(F.contains(source, F.lit(":")), F.substring_index(source, ":", 1)).otherwise("")


# Fixed value: the source of notes that a migration found none for.
MIGRATED = "note:이전됨 — v0.1 규격이라 근거가 안 적혀 있다"


def source_keys(sources: Column) -> Column:
    """Sources as keys: lower case, line marks of files cut, placeholders of migrated notes and blank ones left out."""
    low = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.lower(F.btrim(s)))
    cut = F.transform(low, lambda s: F.when(F.startswith(s, F.lit("note:")), s).otherwise(F.substring_index(s, "#", 1)))
    return F.array_distinct(F.filter(cut, lambda s: (s != "") & (s != MIGRATED)))


def mem_sources(sources: Column) -> Column:
    return F.transform(F.filter(sources, lambda s: F.startswith(s, F.lit("mem:"))), lambda s: F.substring(s, F.lit(5), F.length(s)))


def basis_hash(parts: Column) -> Column:
    """First eight hex digits of the SHA-256 of the sorted parts."""
    return F.left(F.sha2(F.array_join(F.array_sort(parts), "\n"), 256), F.lit(8))


def line_cites(body: Column) -> Column:
    """Ids cited as [mem:id], for each numbered line."""
    numbered = F.filter(lines(body), lambda x: F.regexp_like(x, F.lit(r"^\s*\d+[.)]")))
    return F.transform(numbered, lambda x: F.regexp_extract_all(x, F.lit(r"\[mem:([0-9a-f-]+)\]"), F.lit(1)))


def identifiers(text: Column) -> Column:
    """ASCII words of four characters or more that have a letter."""
    return F.array_distinct(F.filter(words(text, 4), lambda w: F.regexp_like(w, F.lit(r"^[a-z0-9]*[a-z][a-z0-9]*$"))))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character."""

    def of(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
        return F.aggregate(shares, F.lit(0.0), lambda t, p: t - p * F.log2(p))

    return bound(F.split(token, "", -1), of)
