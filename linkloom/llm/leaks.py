"""Evaluation texts that leak into training texts.

Both sides are levelled to a stream of letters and digits: width, case, blanks, line breaks, punctuation, quoting and
markup fall away. The n-grams of all items form one hash set, broadcast to the tasks; the windows of every document are
looked up in it. Each hit is verified on the spot: the match is extended to both sides through single changed, lost or
added characters, and every run that holds the asked share of an item is reported. All n-grams start matches, also those
that many items share: a passage that stands in many items is found for each of them, and stock phrases fail by their length.

The set is bounded: more than ``block_chars`` characters of items are taken in blocks by a hash of the item, each block one
pass over the documents whose findings are written down before the next block is read, so that neither a broadcast nor the
driver ever holds more than a block. No document is shuffled, so no site, language or length of text can become a hot key.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import checkpointed

_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,200}>|\[/?(?:b|i|u|s|url|quote|code|size|color|img)(?:=[^\]\n]{0,200})?\]|\]\((?:https?:)?[^()\s]{0,300}\)", re.IGNORECASE | re.DOTALL)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w{1,30});")
_BARE = re.compile(r"[\W_]+")
LEAK = "doc_id bigint, item_id bigint, run_chars int, item_chars int, run_share double, start int, end int, spans array<struct<start:int,end:int>>"


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Starters that may compose with the character before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0xC0, 0x30000))
    return frozenset(chr(int(d[1], 16)) for d in pairs if len(d) == 2 and d[0][0] != "<") | {chr(c) for c in range(0x1161, 0x1200)}


@lru_cache(maxsize=100_000)
def _joins(ch: str) -> bool:
    """Whether normalisation may join a character to the one before it."""
    first = unicodedata.normalize("NFKD", ch)[0]
    return unicodedata.combining(first) != 0 or first in _seconds()


def _bare(text: str) -> str:
    return _BARE.sub("", unicodedata.normalize("NFKC", text).casefold())


def level(text: str) -> str:
    """The letters and digits of a text, without width, case and markup."""
    t = _MARKUP.sub("", text) if "<" in text or "]" in text else text
    return _bare(_ENTITY.sub(lambda m: html.unescape(m[0]), t) if "&" in t else t)


def level_with_map(text: str) -> tuple[str, list[int], list[int]]:
    """``level`` of a text and, for each of its characters, where in the text it begins and ends.

    The text is cut at markup, references and wherever normalisation can't reach across; the pieces level to the same as the whole.
    """
    pieces: list[tuple[str, int, int]] = []  # a character, and its place in the text
    last = 0
    for m in _MARKUP.finditer(text):
        pieces += [(c, k, k + 1) for k, c in enumerate(text[last : m.start()], last)]
        last = m.end()
    pieces += [(c, k, k + 1) for k, c in enumerate(text[last:], last)]
    bare = "".join(c for c, _, _ in pieces)
    read: list[tuple[str, int, int]] = []
    last = 0
    for m in _ENTITY.finditer(bare):
        read += pieces[last : m.start()]
        read += [(c, pieces[m.start()][1], pieces[m.end() - 1][2]) for c in html.unescape(m[0])]
        last = m.end()
    read += pieces[last:]
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    i = 0
    while i < len(read):
        j = i + 1
        while j < len(read) and _joins(read[j][0]):
            j += 1
        for c in _bare("".join(x[0] for x in read[i:j])):
            out.append(c)
            starts.append(read[i][1])
            ends.append(read[j - 1][2])
        i = j
    return "".join(out), starts, ends


def extend(doc: str, item: str, i: int, j: int, step: int, anchor: int) -> tuple[int, int]:
    """How far a match goes from doc[i], item[j] in direction ``step``; one character may differ, be lost or be added wherever ``anchor`` equal ones follow."""
    n, m = len(doc), len(item)

    def equal(a: int, b: int) -> bool:
        if step > 0:
            return a + anchor <= n and b + anchor <= m and doc[a : a + anchor] == item[b : b + anchor]
        return a - anchor + 1 >= 0 and b - anchor + 1 >= 0 and doc[a - anchor + 1 : a + 1] == item[b - anchor + 1 : b + 1]

    while 0 <= i < n and 0 <= j < m:
        if doc[i] == item[j]:
            i, j = i + step, j + step
        elif equal(i + step, j + step):
            i, j = i + step, j + step
        elif equal(i + step, j):
            i += step
        elif equal(i, j + step):
            j += step
        else:
            break
    return i, j


class ItemIndex:
    """The hash set of a block of items; items of one levelled text are held once.

    A run must hold ``share`` of the item, and ``least`` letters or the whole item. Seeds are ``gram`` letters long, or as
    long as the run that an item of few letters asks for.
    """

    def __init__(self, items: tuple[tuple[int, str], ...], gram: int, share: float = 0.4, least: int = 8) -> None:
        ids: dict[str, list[int]] = defaultdict(list)
        for k, t in items:
            if flat := level(t):
                ids[flat].append(k)
        self.texts, self.ids = list(ids), list(ids.values())
        self.need = [max(math.ceil(share * len(t) - 1e-9), min(least, len(t))) for t in self.texts]
        self.seeds: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for x, t in enumerate(self.texts):
            size = min(gram, self.need[x])
            where = self.seeds.setdefault(size, defaultdict(list))
            for p in range(len(t) - size + 1):
                where[t[p : p + size]].append((x, p))

    def runs(self, doc: str, anchor: int, gap: int = 6) -> dict[int, list[tuple[int, int, int]]]:
        """By text hit: all runs that hold enough of it, as (letters of the item, first and end place in ``doc``)."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        covered: dict[tuple[int, int], int] = {}  # by text and diagonal: where in the document its runs end
        ends: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}  # by text and stretch of the document that a run ends in
        wide = gap + 1
        for size, where in self.seeds.items():
            for i in [i for i in range(len(doc) - size + 1) if doc[i : i + size] in where]:
                for x, j in where[doc[i : i + size]]:
                    if i < covered.get((x, i - j), 0):
                        continue  # a hit inside a run before
                    item = self.texts[x]
                    a, b = extend(doc, item, i + size, j + size, 1, anchor)
                    c, d = extend(doc, item, i - 1, j - 1, -1, anchor)
                    # a few changed characters close together don't part two runs
                    near = None
                    for e in range((c + 1) // wide - 1, (c + 1) // wide + 2):
                        for a2, b2, c2, d2 in ends.get((x, e), ()):
                            if -gap <= c + 1 - a2 <= gap and -gap <= d + 1 - b2 <= gap and c2 < c and d2 < d and (near is None or (d2, c2) < near):
                                near = d2, c2
                    if near:
                        d, c = near
                    covered[x, i - j] = max(a, covered.get((x, i - j), 0))
                    covered[x, a - b] = max(a, covered.get((x, a - b), 0))
                    held = ends.setdefault((x, a // wide), [])
                    if (a, b, c, d) not in held:
                        held.append((a, b, c, d))
                    if b - d - 1 >= self.need[x]:
                        out[x].append((b - d - 1, c + 1, a))
        return out

    def leaks(self, doc: str, anchor: int) -> list[tuple[int, int, int, float, int, int, list[tuple[int, int]]]]:
        """(item id, letters of the longest run, of the item, share, first and end place of the run, all runs joined where they overlap)."""
        rows = []
        for x, found in self.runs(doc, anchor).items():
            n, a, b = max(found, key=lambda r: (r[0], -r[1]))
            spans: list[list[int]] = []
            for _, c, d in sorted(found, key=lambda r: r[1:]):
                if spans and c <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], d)
                else:
                    spans.append([c, d])
            size = len(self.texts[x])
            rows += [(k, n, size, n / size, a, b, spans) for k in self.ids[x]]
        return rows


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...], gram: int, share: float, least: int) -> ItemIndex:
    return ItemIndex(items, gram, share, least)


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.4, gram: int = 10, anchor: int = 4, least: int = 8, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, run_chars, item_chars, run_share, start, end, spans): documents that hold ``share`` of an item in one run.

    documents(doc_id, text), items(item_id, text). Lengths are of levelled texts; run_chars, start and end are of the
    longest run, spans has the places of all, all in the levelled document. Items whose share is under ``least`` letters
    ask for that many, or for the whole item; null, empty and letterless texts match nothing. Repeated documents and items
    give repeated findings of the same values; a document may hold several items. The whole of every text is scanned.
    """
    texts = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null and text <> '' and doc_id is not null")
    asked = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null and text <> ''").distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars)

    def pass_over(block: tuple[tuple[int, str], ...]) -> DataFrame:
        def scan(batches):
            index = _index(block, gram, share, least)
            for pdf in batches:
                rows = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    for k, n, m, part, a, b, spans in index.leaks(level(text), anchor):
                        rows.append((doc_id, k, n, m, part, a, b, [{"start": s, "end": e} for s, e in spans]))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_chars", "item_chars", "run_share", "start", "end", "spans"])

        return texts.mapInPandas(scan, LEAK)

    parts = []
    for n in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        block = tuple(sorted((r[0], r[1]) for r in mine.collect()))
        if block:
            parts.append(pass_over(block) if blocks == 1 else checkpointed(pass_over(block)))
    return reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], LEAK)


def remove_leaks(documents: DataFrame, leaks: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """``documents`` with all leaked spans cut out, and without documents of which leaks make up ``drop_share`` or more.

    doc_id names one text. Columns leak_items ARRAY<BIGINT> (null where nothing leaked) and leak_chars INT are added, in
    place of any of these names. The text between the remaining parts is joined by a line break. Documents with null texts
    or ids pass through.
    """

    @F.pandas_udf("struct<text:string,cut:int,size:int>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, span in zip(texts, spans, strict=True):
            if text is None or span is None or len(span) == 0:
                out.append((text, 0, 0 if text is None else len(text)))
                continue
            flat, starts, ends = level_with_map(text)
            merged: list[list[int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in span):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, place = [], 0
            for a, b in merged:
                kept.append(text[place : max(place, starts[a])])
                place = max(place, ends[b - 1])
            kept.append(text[place:])
            out.append(("\n".join(x for x in kept if x), sum(b - a for a, b in merged), len(flat)))
        return pd.DataFrame(out, columns=["text", "cut", "size"])

    found = leaks.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("leak_items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("__spans"))
    own = documents.drop("leak_items", "leak_chars", "__spans", "__cut")
    joined = own.join(found, "doc_id", "left").withColumn("__cut", cut("text", "__spans"))
    kept = joined.where(F.col("__spans").isNull() | (F.col("__cut")["cut"] < drop_share * F.col("__cut")["size"]))
    return kept.withColumn("text", F.col("__cut")["text"]).withColumn("leak_chars", F.col("__cut")["cut"]).drop("__spans", "__cut")
