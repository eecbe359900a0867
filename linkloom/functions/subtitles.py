"""Whether two subtitles mean one episode.

Three questions, each weaker than the one before: do they identify (``same_identity``), do they agree once date and number
have proved the episode (``date_proven``), do they agree once the episode is selected (``agrees``). Each is an OR of named
rules over parts and segments of the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F

from linkloom.functions.text import SPACES, identity_key, scoring_key, search_key, trim

# Pairs of subtitles that differ by a slip alone.
KNOWN_PAIRS = [{"かんばれムース", "がんばれムース"}]
# Subtitles that say no more than that it is the last episode.
GENERIC_FINALS = frozenset("最終話 最終回 最終話sp 最終回sp 最終話スペシャル 最終回スペシャル".split())

_ORDINAL = re.compile(r"^(?:episode\d+|其の[0-9一二三四五六七八九十]+|[a-z]:)")
_OTHERS = re.compile(rf"[{SPACES}]*(?:ほか|他)(?:[{SPACES}]*[0-9０-９〇一二三四五六七八九十]+[{SPACES}]*本)?[{SPACES}]*$")
_ZERO = re.compile(r"^life[. ]*0+(?: |$)")
_DASHES, _WAVES = "-‐‑‒–—―", "~〜～"
_PAIRS = {"(": ")", "（": "）", "「": "」", "『": "』"}


def parts(s: str) -> list[str]:
    """The stories of a subtitle that slashes part."""
    return [k for k in map(scoring_key, re.split("[/／]", s)) if k]


def segments(s: str) -> list[str]:
    """The stories of a subtitle that slashes, ampersands or commas part, without their ordinals."""
    return [k for k in (_ORDINAL.sub("", scoring_key(x)) for x in re.split("[/／&＆、]", s)) if k]


def runs_within(short: list[str], whole: list[str], least: int = 3) -> bool:
    """Whether ``short`` stands in ``whole``, side by side and in order, with so many letters at least."""
    n = len(short)
    return 0 < n <= len(whole) and sum(map(len, short)) >= least and any(whole[i : i + n] == short for i in range(len(whole) - n + 1))


def one_changed(a: str, b: str, least: int = 10) -> bool:
    return len(a) == len(b) >= least and sum(x != y for x, y in zip(a, b)) == 1


def one_added(a: str, b: str, least: int = 10) -> bool:
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and len(b) >= least and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def same_identity(a: str, b: str) -> bool:
    return identity_key(a) == identity_key(b) != ""


def same_parts(a: str, b: str) -> bool:
    """The same stories in any order, two at least."""
    x, y = parts(a), parts(b)
    return len(x) >= 2 and Counter(x) == Counter(y)


def composite_part(complete: str, observed: str) -> bool:
    """Some of the stories of ``complete``, but not all."""
    x, y = parts(complete), parts(observed)
    return len(y) < len(x) and runs_within(y, x)


def numbered_segments(a: str, b: str) -> bool:
    """One side numbers what the other tells as one segment (in Roman numerals behind Japanese)."""

    def folded(found: list[str]) -> list[str]:
        return [k for k, _ in groupby(re.sub(r"(?<=[ぁ-ヿ㐀-鿿々])i{1,2}$", "", x) for x in found)]

    x, y = segments(a), segments(b)
    return folded(x) == folded(y) != [] and (folded(x) != x or folded(y) != y)


def others_named(summary: str, full: str) -> bool:
    """Segments and 'and others': the named ones come in ``full``, in order; a long one may differ in a letter."""
    m = _OTHERS.search(summary)
    if not m or m.start() == 0:
        return False
    named, rest = segments(trim(summary[: m.start()])), iter(segments(full))
    return bool(named) and all(len(x) >= 3 and any(x == y or one_changed(x, y) for y in rest) for x in named)


def _bracketed_end(text: str, opening: str) -> list[tuple[str, str]]:
    """(before, inside) for every opening bracket whose closing one ends the text."""
    text = trim(text)
    return [(text[:i], text[i + 1 : -1]) for i, c in enumerate(text[:-1]) if c in opening and text[-1] == _PAIRS.get(c)]


def long_expansion(base: str, expanded: str, least: int = 8) -> bool:
    """A long title, and in brackets behind it a long text that only one side has."""
    key = scoring_key(base)
    return len(key) >= least and any(scoring_key(x) == key and len(scoring_key(y)) >= least for x, y in _bracketed_end(expanded, "(（"))


def decorated(base: str, text: str, least: int = 4) -> bool:
    """A title with a gloss between dashes or waves behind it, or an emoticon in brackets."""
    key, text = scoring_key(base), trim(text)
    if len(key) < least:
        return False
    for signs in (_DASHES, _WAVES):
        if text[-1:] and text[-1] in signs:
            for i, c in enumerate(text[:-1]):
                if c in signs and scoring_key(text[:i]) == key and len(scoring_key(text[i + 1 : -1])) >= least:
                    return True
    return any(scoring_key(x) == key and len(y) >= 3 and not any(unicodedata.category(c)[0] in "LN" for c in y) for x, y in _bracketed_end(text, "(（"))


def bracket_part(container: str, whole: str, least: int = 3) -> bool:
    """What one side has alone is in brackets on the other."""
    key = scoring_key(whole)
    inside = (m[1] for o, c in _PAIRS.items() for m in re.finditer(re.escape(o) + "([^" + re.escape(c) + "]*)" + re.escape(c), container))
    return len(key) >= least and any(scoring_key(x) == key for x in inside)


def trailing_label(container: str, whole: str, least: int = 5) -> bool:
    """The last words of a text at least three times as long."""
    key, fields = scoring_key(whole), search_key(container).split(" ")
    return len(key) >= least and len(scoring_key(container)) >= 3 * len(key) and any(scoring_key("".join(fields[i:])) == key for i in range(1, len(fields)))


def date_proven(complete: str, observed: str) -> bool:
    return same_identity(complete, observed) or composite_part(complete, observed) or same_parts(complete, observed) or others_named(observed, complete)


def structured(a: str, b: str) -> bool:
    """One side is a part, a summary or an expansion of the other."""
    either = (lambda x, y: runs_within(segments(x), segments(y)), others_named, long_expansion, decorated, bracket_part)
    return numbered_segments(a, b) or any(rule(a, b) or rule(b, a) for rule in either)


def agrees(a: str, b: str) -> bool:
    x, y = scoring_key(a), scoring_key(b)
    return bool(x and y) and (x == y or {x, y} in KNOWN_PAIRS or structured(a, b) or trailing_label(a, b) or trailing_label(b, a) or one_added(x, y))


def partly(a: str, b: str) -> bool:
    """Equal, or one within the other, both of more than two letters."""
    x, y = search_key(a), search_key(b)
    return x == y or len(x) > 2 and len(y) > 2 and (x in y or y in x)


def is_generic_final(s: str) -> bool:
    return identity_key(s) in GENERIC_FINALS


def is_zero_label(s: str) -> bool:
    """A label that says outright that the episode is number zero."""
    return bool(_ZERO.match(search_key(s).lower()))


def unavailable(title: str) -> bool:
    """No title: blank, or the particle that stands padded in its place."""
    t = trim(title)
    return not t or t == "と" != title


def relation():
    """How two columns of subtitles relate: 3 identity, 2 proven by date, 1 agree, 0 partly, -1 not; null where either is missing."""

    @F.pandas_udf("int")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], int] = {}
        out = []
        for a, b in zip(left, right, strict=True):
            if a is None or b is None or unavailable(a) or unavailable(b):
                out.append(None)
                continue
            if (a, b) not in known:
                known[a, b] = 3 if same_identity(a, b) else 2 if date_proven(a, b) else 1 if agrees(a, b) else 0 if partly(a, b) else -1
            out.append(known[a, b])
        return pd.Series(out, dtype="Int32")

    return of
