"""Free-entered labels to a canonical list: a trie with alias paths, searched by a Levenshtein automaton.

Every entry of the reference list lies in the trie under its own spelling and under alias paths (other counter words,
notations and readings). A query is tokenised first: every numeral, in whatever notation, becomes one number token that
can neither be edited, inserted nor dropped, so that an edit never turns one number into another. The automaton walks the
trie with one row of edit distances a node and leaves a branch once no cell is within the limit, which depends on the
length of the query.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Alias paths of numbered entries; {n} is the number.
NUMBER_PATHS = (
    "第{n}話 {n}話 第{n}回 {n}回 第{n}わ {n}わ 第{n}羽 第{n}夜 第{n}活 第{n}幕 第{n}局 第{n}章 第{n}集 第{n}巻 第{n}編 第{n}弾 第{n}番 第{n}怪 第{n}駅 第{n}席 {n}杯目 "
    "#{n} ♯{n} ＃{n} {n} ({n}) no.{n} № {n} ep{n} ep.{n} eps{n} episode{n} chapter{n} chap{n} ch{n} act{n} vol{n} part{n} story{n} その{n} 其の{n} 其{n} 巻の{n} dai{n}wa {n}thep {n}step {n}ndep {n}rdep {n}thepisode"
).split()
# What may follow any numbered path.
NUMBER_TAILS = ("", "再", "再放送", "完", "終", "。")
# Alias paths of entries that are words, by the entry's spelling.
WORD_PATHS = {
    "最終話": "最終話 最終回 さいしゅうわ 最終わ ファイナル final finalepisode finale lastepisode 最終話完",
    "総集編": "総集編 総集篇 総集へん そうしゅうへん ソウシュウヘン 総集編sp 総集編スペシャル digest recap 総集回",
    "特別編": "特別編 特別篇 特別へん とくべつへん トクベツヘン スペシャル special sp tvsp tvスペシャル specialepisode 特番 特別回",
    "OVA": "ova オーブイエー originalvideoanimation オリジナルビデオアニメ",
    "前編": "前編 前篇 前へん ぜんぺん ゼンペン firstpart",
    "中編": "中編 中篇 中へん ちゅうへん チュウヘン middlepart",
    "後編": "後編 後篇 後へん こうへん コウヘン latterpart secondpart",
    "プロローグ": "プロローグ prologue ぷろろーぐ プロローグ編",
    "エピローグ": "エピローグ epilogue えぴろーぐ エピローグ編",
    "番外編": "番外編 番外篇 番外へん ばんがいへん バンガイヘン extra extraepisode 番外",
    "未放送話": "未放送話 未放送回 未放送 みほうそう みほうそうわ tv未放送 unaired unairedepisode 未放映話",
}
# Digits and units of kanji numerals, legal forms included.
KANJI_DIGITS = {"〇": 0, "零": 0, "一": 1, "壱": 1, "壹": 1, "二": 2, "弐": 2, "貳": 2, "三": 3, "参": 3, "參": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陸": 6, "七": 7, "漆": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
KANJI_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "阡": 1000}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

_ROMAN_SHAPE = re.compile(r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")
_KANJI = "[" + "".join([*KANJI_DIGITS, *KANJI_UNITS]) + "]+"
_NUMBER = re.compile(r"(?P<dec>\d+(?:\.\d+)?)|(?P<kanji>" + _KANJI + r")|(?<![A-Za-z])(?<![A-Za-z]\.)(?P<roman>[IVXLCDM]+)(?!\.?[A-Za-z])")
_DROPPED = re.compile(r"[\s.,、。・'’\"“”`´!?:;()\[\]{}<>「」『』【】〈〉《》〔〕_*|/\\~-]")


def kanji_number(text: str) -> int | None:
    """The value of a kanji numeral, positional (二三) or with units (二十三); None where it is malformed."""
    if not any(c in KANJI_UNITS for c in text):
        return int("".join(str(KANJI_DIGITS[c]) for c in text)) if text else None
    total, digit, last = 0, None, 10_000
    for c in text:
        if c in KANJI_UNITS:
            unit = KANJI_UNITS[c]
            if unit >= last or digit == 0:
                return None
            total, digit, last = total + (1 if digit is None else digit) * unit, None, unit
        else:
            if digit is not None:
                return None
            digit = KANJI_DIGITS[c]
    return total + (digit or 0)


def roman_number(text: str) -> int | None:
    if not text or not _ROMAN_SHAPE.fullmatch(text):
        return None
    values = [ROMAN[c] for c in text]
    return sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def canonical_number(text: str) -> str:
    """12.50 -> 12.5, 007 -> 7, 3.0 -> 3."""
    whole, _, fraction = text.partition(".")
    fraction = fraction.rstrip("0")
    return (whole.lstrip("0") or "0") + (f".{fraction}" if fraction else "")


def tokenise(label: str) -> list[str]:
    """Symbols of a label: single characters, and '=n' for a numeral. Width, case, blanks and brackets are levelled.

    A sign that joins two numbers (a range, a list) stays a symbol: such a label means no single entry.
    """
    text = unicodedata.normalize("NFKC", label)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    out: list[str] = []
    at = 0
    for m in _NUMBER.finditer(text):
        if m["dec"]:
            value = canonical_number(m["dec"])
        else:
            n = kanji_number(m["kanji"]) if m["kanji"] else roman_number(m["roman"])
            if n is None:
                continue
            value = str(n)
        out += list(_DROPPED.sub("", text[at : m.start()]).casefold())
        out.append("=" + value)
        at = m.end()
    return out + list(_DROPPED.sub("", text[at:]).casefold())


def distance_limit(symbols: list[str]) -> int:
    """Edits allowed for a query: by its length, where a kana or kanji counts as two letters and a number as none."""
    weight = sum(0 if s[0] == "=" and len(s) > 1 else 2 if ord(s) > 0x2E7F else 1 for s in symbols)
    return 0 if weight < 4 else 1 if weight < 9 else 2


#: Labels whose result a worker remembers.
REMEMBERED = 200_000
#: The edge of a numbered path that any number walks; which entry is meant is looked up by the number itself.
ANY = "=*"


@lru_cache(maxsize=1)
def numbered_root() -> dict:
    """The trie of the numbered alias paths, the same for every number: its size does not grow with the reference list."""
    root: dict = {}
    for path in NUMBER_PATHS:
        for tail in NUMBER_TAILS:
            _insert(root, [ANY if _is_number(s) else s for s in tokenise(path.replace("{n}", " 1 ") + tail)], True)
    return root


def _is_number(symbol: str) -> bool:
    return len(symbol) > 1


def _insert(root: dict, symbols: list[str], mark: object) -> None:
    node = root
    for s in symbols:
        node = node.setdefault(s, {})
    node.setdefault(None, set()).add(mark)


class LabelTrie:
    """Reference entries and their alias paths; ``search`` gives all entries within the limit of a query.

    Entries that are nothing but a numbered counter share one trie of paths; all others lie in a trie of their own with
    their aliases.
    """

    def __init__(self, entries: Iterable[tuple[int, str]]) -> None:
        self.root: dict = {}
        self.by_number: dict[str, set[int]] = {}
        self.known: dict[str, tuple[list[tuple[int, int]], int]] = {}
        for key, label in sorted(entries):
            if label is None:
                continue
            own = tokenise(label)
            numbers = [s for s in own if _is_number(s)]
            if len(numbers) == 1 and "".join("=" if s in numbers else s for s in own) == "第=話":
                self.by_number.setdefault(numbers[0], set()).add(key)
            elif own:
                _insert(self.root, own, key)
            for path in WORD_PATHS.get(label, "").split():
                _insert(self.root, tokenise(path), key)

    def search(self, symbols: list[str], limit: int) -> dict[int, int]:
        """The least distance of each entry within the limit. Distances are Levenshtein's, a swap of neighbours counting one; number tokens match only themselves."""
        if not symbols:
            return {}
        found = automaton(self.root, symbols, limit)
        numbers = [s for s in symbols if _is_number(s)]
        if len(numbers) == 1 and numbers[0] in self.by_number:
            for d in automaton(numbered_root(), [ANY if s == numbers[0] else s for s in symbols], limit).values():
                for key in self.by_number[numbers[0]]:
                    found[key] = min(found.get(key, d), d)
        return found


def automaton(root: dict, symbols: list[str], limit: int) -> dict:
    """The marks of a trie within ``limit`` edits of the symbols, with their distances: one row of distances a node."""
    found: dict = {}
    far = limit + 1
    fixed = [_is_number(s) for s in symbols]
    first = [0]
    for f in fixed:
        first.append(far if f else min(far, first[-1] + 1))

    def walk(node: dict, row: list[int], before: list[int] | None, came: str | None) -> None:
        for edge, child in node.items():
            if edge is None:
                if row[-1] <= limit:
                    for mark in child:
                        found[mark] = min(found.get(mark, far), row[-1])
                continue
            number = _is_number(edge)
            new = [far if number else min(far, row[0] + 1)]
            for j, s in enumerate(symbols, 1):
                cost = row[j - 1] if s == edge else far if number or fixed[j - 1] else row[j - 1] + 1
                if not number:
                    cost = min(cost, row[j] + 1)
                if not fixed[j - 1]:
                    cost = min(cost, new[j - 1] + 1)
                    if before is not None and j > 1 and s == came and symbols[j - 2] == edge and not number and not fixed[j - 2]:
                        cost = min(cost, before[j - 2] + 1)
                new.append(min(far, cost))
            if min(new) <= limit:
                walk(child, new, row, edge)

    walk(root, first, None, None)
    return found


def best_entry(trie: LabelTrie, label: str) -> tuple[list[tuple[int, int]], int]:
    """All (entry, distance) within the limit, nearest first, and the one meant: 0 where none or several are nearest."""
    if label in trie.known:
        return trie.known[label]
    symbols = tokenise(label)
    found = sorted(trie.search(symbols, distance_limit(symbols)).items(), key=lambda kv: (kv[1], kv[0]))
    nearest = [k for k, d in found if d == found[0][1]]
    if len(trie.known) >= REMEMBERED:
        trie.known.clear()
    trie.known[label] = found, nearest[0] if len(nearest) == 1 else 0
    return trie.known[label]


@lru_cache(maxsize=4)
def _trie(entries: tuple[tuple[int, str], ...]) -> LabelTrie:
    return LabelTrie(entries)


#: Letters of the reference list, in all, that go to every task (a node of the trie takes some hundred bytes).
MAX_REFERENCE_CHARS = 2_000_000


def reference_entries(reference: DataFrame) -> tuple[tuple[int, str], ...]:
    """The list (label_id, label) on the driver; it is measured first and refused beyond MAX_REFERENCE_CHARS, as it goes to every task."""
    rows = reference.select("label_id", "label").where("label_id is not null and label is not null").distinct()
    size = rows.agg(F.sum(F.length("label") + 8)).first()[0] or 0
    if size > MAX_REFERENCE_CHARS:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE_CHARS} letters")
    return tuple(sorted((int(r[0]), r[1]) for r in rows.collect()))


def map_labels(df: DataFrame, column: str, reference: DataFrame, out: str = "label_id", candidates: str = "label_candidates", exact: str = "label_exact") -> DataFrame:
    """``df`` with ``out`` BIGINT, the entry that ``column`` means (0: none; null where the label is null or blank),
    ``exact`` BOOLEAN, whether it is spelt like an entry, and ``candidates`` ARRAY<STRUCT<label_id BIGINT, distance INT>>, all entries within the limit, nearest first.

    Two entries equally near leave the label unmatched (0), with both among the candidates. Rows are kept one to one and
    in place (no shuffle, so no label can be too frequent); each worker remembers the labels that it has met.
    """
    entries = reference_entries(reference)

    spelt = frozenset(label for _, label in entries)

    @F.pandas_udf("struct<best:bigint,exact:boolean,all:array<struct<label_id:bigint,distance:int>>>")
    def mapped(labels: pd.Series) -> pd.DataFrame:
        trie = _trie(entries)
        best, exact, every = [], [], []
        for label in labels:
            blank = label is None or not label.strip()
            found, one = (None, None) if blank else best_entry(trie, label)
            best.append(one)
            exact.append(None if blank else label in spelt)
            every.append(None if blank else [{"label_id": k, "distance": d} for k, d in found])
        return pd.DataFrame({"best": pd.array(best, dtype="Int64"), "exact": pd.array(exact, dtype="boolean"), "all": pd.Series(every, dtype=object)})

    name = "__ll_label"
    while name in df.columns:
        name += "_"
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (out, candidates, exact)]
    return df.withColumn(name, mapped(F.col(f"`{column}`"))).select(*keep, F.col(name)["best"].alias(out), F.col(name)["all"].alias(candidates), F.col(name)["exact"].alias(exact))
