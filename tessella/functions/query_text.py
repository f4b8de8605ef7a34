"""Query words on the driver: script runs, predicates on index terms, splits by a vocabulary. A query is a few words long."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

HANGUL = re.compile(r"[가-힣]+")
#: Parts of a split word and candidates of splits, at most.
PARTS, SPLITS = 3, 6


def plain_number(word: str) -> str:
    """5,000 as 5000, also inside a word."""
    return re.sub(r"(?<!\d)\d{1,3}(?:,\d{3})+(?!\d)", lambda m: m[0].replace(",", ""), word)


def bigrams(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)] or ([run] if run else [])


@dataclass(frozen=True)
class Run:
    """A part of a word in one script: ko, ko1 (one Hangul letter) or en (two letters or digits of another script, or more)."""

    text: str
    kind: str


def runs(word: str) -> list[Run]:
    """Parts of a word at script borders; signs at their ends go, and so do single letters of other scripts than Hangul."""
    out = []
    for part in re.split(r"([가-힣]+)", plain_number(word.strip())):
        if HANGUL.fullmatch(part):
            out.append(Run(part, "ko" if len(part) > 1 else "ko1"))
        elif len(p := part.strip().strip("()[]{}<>,.;:!?\"'`")) > 1 and any(c.isalnum() for c in p):
            out.append(Run(p, "en"))
    return out


@dataclass(frozen=True)
class Ask:
    """A predicate on a note's tokens: all terms (as a phrase if more than one), or any term with the prefix, in these fields or any."""

    terms: tuple[str, ...] = ()
    prefix: str = ""
    fields: tuple[str, ...] = ()


HEAD = ("title", "meta", "summary")


def ask_for(run: Run, head_only: bool = False) -> Ask:
    """Hangul runs are phrases of bigrams, one Hangul letter and other runs are prefixes; head_only keeps the letter's to the head fields."""
    if run.kind == "ko":
        return Ask(tuple(bigrams(run.text)))
    return Ask(prefix=run.text.lower(), fields=HEAD if head_only and run.kind == "ko1" else ())


def term_asks(word: str) -> list[Ask]:
    """What a query word asks for: each of its runs."""
    return [ask_for(r, head_only=True) for r in runs(word)]


def phrase_ask(text: str) -> Ask:
    """A quoted group as the phrase of its index tokens."""
    out: list[str] = []
    for w in re.split(r"[\W_]+", text.lower()):
        for part in re.split(r"([가-힣]+)", w):
            if part:
                out += bigrams(part) if HANGUL.fullmatch(part) else [part]
    return Ask(tuple(out))


def one_letter_ask(text: str) -> Ask | None:
    """A single Hangul letter asks for what begins so."""
    return Ask(prefix=text) if len(text) == 1 and HANGUL.fullmatch(text) else None


def prefix_ask(text: str) -> Ask:
    """The shape of the ladder's prefix rung."""
    return Ask(tuple(bigrams(text))) if HANGUL.search(text) else Ask(prefix=text.lower())


def glued_ask(text: str) -> Ask | None:
    """The word as one literal token."""
    return Ask((text.lower(),)) if text else None


def every_ask(query: str) -> list[Ask]:
    """The conjunction of all words' predicates."""
    return [a for w in query.split() for a in term_asks(w)]


def latin_only(tokens: list[str]) -> list[str]:
    return [t for t in tokens if not HANGUL.search(t)]


def despace(text: str) -> str:
    return "".join(text.split())


def jamo(text: str) -> str:
    """Hangul syllables as their letters, all else as it is."""
    return "".join(unicodedata.normalize("NFD", c) if "가" <= c <= "힣" else c for c in text)


def like_escape(text: str) -> str:
    """A literal for LIKE, with backslash as the escape sign."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def extras(chunk: str) -> list[str]:
    """Besides a chunk of other script: its parts at signs and at capitals, and its numbers without commas, each once, lower case."""
    parts = [p for p in re.split(r"[\W_]+", chunk) if p]
    camel = [c for p in parts for c in re.split(r"(?<!^)(?=[A-Z])", p)]
    found = [x.lower() for x in (*parts, *camel, plain_number(chunk)) if x and x.lower() != chunk.lower()]
    return list(dict.fromkeys(found))


Known = Callable[[str], bool]


def known_prefix(word: str, known: Known) -> str | None:
    """The longest known beginning of two letters or more."""
    return next((word[:n] for n in range(len(word), 1, -1) if known(word[:n])), None)


def split_by_vocabulary(word: str, known: Known) -> tuple[str, str] | None:
    """The longest known beginning with a known rest."""
    pairs = split_pairs(word, known)
    return pairs[0] if pairs else None


def split_pairs(word: str, known: Known) -> list[tuple[str, str]]:
    """All two-way splits of a Hangul word of four letters or more into known halves of two or more, the longest beginning first."""
    if len(word) < 4 or not HANGUL.fullmatch(word):
        return []
    return [(word[:n], word[n:]) for n in range(len(word) - 2, 1, -1) if known(word[:n]) and known(word[n:])]


def split_vocabulary(word: str, known: Known) -> list[tuple[str, ...]]:
    """Two-way, then three-way splits of a Hangul word, six at most."""
    if not HANGUL.fullmatch(word):
        return []
    deeper = [(word[:n], *pair) for n in range(2, len(word) - 3) if known(word[:n]) for pair in split_pairs(word[n:], known)]
    return [*split_pairs(word, known), *deeper][:SPLITS]


def both_ways(table: dict[str, list[str]]) -> dict[str, list[str]]:
    """A synonym table in which each word of a pair has the other."""
    out: dict[str, set[str]] = {}
    for a, others in table.items():
        for b in others:
            if a != b:
                out.setdefault(a, set()).add(b)
                out.setdefault(b, set()).add(a)
    return {k: sorted(v) for k, v in sorted(out.items())}


def scope_for(table: dict[str, str], folder: str) -> str:
    """The scope of a folder: its base name's entry, the entry of any case, or the name in lower case."""
    base = re.split(r"[\\/]", folder.rstrip("\\/"))[-1]
    if base in table:
        return table[base]
    return next((v for k, v in sorted(table.items()) if k.lower() == base.lower()), base.lower())


def strict_rung(rung: int) -> bool:
    """Rungs that count as answers to what was asked."""
    return rung in (0, 1, 2, 5, 7)


def since_date(value: str, as_of: str) -> str | None:
    """`30d` or an ISO date as an ISO date."""
    from datetime import date, timedelta

    if m := re.fullmatch(r"(\d{1,5})d", value.strip()):
        return (date.fromisoformat(as_of) - timedelta(days=int(m[1]))).isoformat()
    try:
        return date.fromisoformat(value.strip()).isoformat()
    except ValueError:
        return None
