"""Keyword-stuffed and link-list pages.

A page is cut into lines, and lines into prose, dated entries (episode lists, broadcast times) and list matter: links,
tags, strings of keywords. List density is the share of list matter in the page. Every line, prose too, is exploded into
phrase shingles: what stands between two delimiters, or every run of a few words of it. The distinct hosts that carry a
phrase are counted over the whole corpus: a page is stuffed where list matter is more than half of it and this matter is
stitched from phrases that other hosts carry as well, from links, or from the same phrases over and over.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import checkpointed

_URL = re.compile(r"(?:https?://|www\.)[^\s\[\]<>()「」『』、。]+")
_ANCHOR = re.compile(r"\[url=[^\]]*\](.*?)\[/url\]|<a\s[^>]*>(.*?)</a>|\[([^\[\]\n]*)\]\((?:https?://|/)[^)\s]*\)", re.IGNORECASE)
_TAG = re.compile(r"#[^\s#,、]+")
_ENTRY = re.compile(r"第\s*[0-9.]+\s*話|\bep(?:isode|\.)?\s*\d|\d{1,2}:\d{2}|\d{1,2}月\d{1,2}日", re.IGNORECASE)
_PARTS = re.compile(r"(?:[^\w'-]|_)+")
#: What parts phrases: signs, but no blanks within a line.
_DELIMITERS = re.compile(r"(?:[^\w\s'-]|_|\n)+")
_JAPANESE = re.compile(r"[぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_][\w'-]*")
# Words that sentences are held together with.
GLUE_WORDS = frozenset(
    "the a an of and to in with for on at that is are was were it its from by not no but who how one two has had have left out into over when while more than this there until after before once about as so or if all any be been i we you he she they what where which would will can could may none nobody".split()
)
# Kana that sentences are held together with.
GLUE_KANA = frozenset("はがをにでもた")


def unspaced(line: str) -> str:
    """A line whose letters are spaced or hyphenated one by one, closed up; wider gaps stay gaps."""
    for sign in (" ", "-"):
        pieces = line.split(sign)
        single = sum(1 for p in pieces if len(p) == 1)
        if len(pieces) >= 6 and single >= 0.75 * sum(1 for p in pieces if p):
            return re.sub(r"(?<=\S)" + re.escape(sign) + r"(?=\S)", "", line) if sign == " " else line.replace("-", "")
    # keywords whose letters are hyphenated, with blanks between the keywords
    words = line.split()
    if len(words) >= 4 and sum(1 for w in words if re.fullmatch(r"\S(?:-\S)+", w)) >= 0.5 * len(words):
        return re.sub(r"(?<=\S)-(?=\S)", "", line)
    return line


def is_prose(text: str) -> bool:
    """Whether a text, without links and tags, is held together by the glue of sentences."""
    t = text.strip()
    if not t:
        return False
    if 2 * len(_JAPANESE.findall(t)) < len(re.sub(r"\s", "", t)):
        words = _WORD.findall(t)
        return len(words) >= 5 and sum(w.lower() in GLUE_WORDS for w in words) >= 0.2 * len(words)
    def mean(x: str) -> float:
        runs = [r for r in _PARTS.split(x) if r]
        return sum(map(len, runs)) / max(1, len(runs))

    # Japanese sentences need no blanks, so stray ones are overlooked where full stops are
    return ("。" in t and mean(re.sub(r"\s", "", t)) >= 7) or (mean(t) >= 11 and len(GLUE_KANA & set(t)) >= 3)


def shingles(line: str, words: int):
    """(phrase, characters) of a line: each delimited piece of up to ``words`` words, or every run of so many words.

    The characters of a piece are dealt to its runs by the word that each begins with, so that they add up to the piece.
    """
    for piece in _DELIMITERS.split(line):
        run = piece.casefold().split()
        last = len(run) - words
        for i in range(max(1, last + 1) if run else 0):
            yield " ".join(run[i : i + words]), sum(map(len, run[i:])) if i >= last else len(run[i])


def dissect(text: str, shingle: int = 6, words: int = 2) -> tuple[int, int, int, float, dict[str, int]]:
    """(characters, of list matter, of links in it, share of list matter that repeats within the page, phrases).

    Blanks do not count. What repeats are stretches of a few letters, or words, whichever are more. phrases are the
    shingles of the whole page, with the characters of list matter that each covers. Lines that are no prose alone are tried
    again joined, as a text may be broken into short lines.
    """
    total = listed = linked = 0
    matter: list[str] = []
    closed = False
    phrases: dict[str, int] = {}
    held: list[tuple[str, int]] = []

    def note(line: str, weight: int) -> None:
        for phrase, n in shingles(line, words):
            phrases[phrase] = phrases.get(phrase, 0) + n * weight

    def close() -> None:
        nonlocal listed
        if not held:
            return
        lines = [x for x, _ in held]
        if len(lines) > 1 and (is_prose("".join(lines)) or is_prose(" ".join(lines))):
            note(" ".join(lines), 0)
            held.clear()
            return
        for line, n in held:
            listed += n
            matter.append(line)
        held.clear()

    # a wide blank among spaced letters parts words, so it counts as a wider gap
    for raw in unicodedata.normalize("NFKC", text.replace("\u3000", "  ")).split("\n"):
        if not raw.strip():
            continue
        size = len(re.sub(r"\s", "", raw))
        total += size
        line = unspaced(raw)
        closed = closed or line != raw
        links = _URL.findall(line)
        rest = _URL.sub(" ", _ANCHOR.sub(lambda m: " " + next((g for g in m.groups() if g), "") + " , ", line))
        tags = _TAG.findall(rest)
        plain = _TAG.sub(" ", rest)
        if is_prose(plain) or not links and len(tags) < 2 and _ENTRY.search(line):
            close()
            note(plain, 0)
        elif links or tags:
            close()
            listed += size
            if links:
                linked += size
            matter.append(" , ".join([plain, *tags]))
        else:
            held.append((line, size))
    close()
    for line in matter:
        note(line, 1)
    flat = [re.sub(r"\s+", " ", line) for line in matter]
    stream = "\n".join(flat)
    if closed:
        shingle = max(2, shingle // 3)  # closed up, keywords have lost the gaps between them
    windows = Counter(stream[i : i + shingle] for i in range(len(stream) - shingle + 1))
    again = sum(n for n in windows.values() if n > 1) / max(1, sum(windows.values()))
    # words that come more than once, where a list has blanks or signs between them
    counts = Counter(w for line in matter for w in _PARTS.split(line.casefold()) if w)
    echo = sum(len(w) * n for w, n in counts.items() if n > 1) / max(1, sum(len(w) * n for w, n in counts.items()))
    again = max(again, echo)
    return total, listed, linked, again, phrases


UNITS = "doc_id bigint, site string, chars int, listed int, linked int, again double, phrases array<bigint>, covers array<int>"


def list_units(documents: DataFrame, words: int = 2) -> DataFrame:
    """A row for each document with a text: its size, its list matter, and its phrases; columns as in UNITS.

    phrases are hashes, covers the characters of list matter that each covers.
    """

    def scan(batches):
        import numpy as np
        import xxhash

        for pdf in batches:
            rows = []
            for doc_id, site, text in zip(pdf["doc_id"], pdf["site"], pdf["text"], strict=True):
                total, listed, linked, again, found = dissect(text, words=words)
                hashes = np.fromiter((xxhash.xxh64_intdigest(p.encode()) - (1 << 63) for p in found), "int64", len(found))
                covers = np.fromiter(found.values(), "int32", len(found))
                rows.append((doc_id, site, total, listed, linked, again, hashes, covers))
            yield pd.DataFrame(rows, columns=["doc_id", "site", "chars", "listed", "linked", "again", "phrases", "covers"])

    cols = documents.select(F.col("doc_id").cast("long"), "site", "text").where("doc_id is not null and text is not null and text <> ''")
    return cols.mapInPandas(scan, UNITS)


def stuffed_pages(documents: DataFrame, density: float = 0.5, hosts: int = 3, evidence: float = 0.5, words: int = 2) -> DataFrame:
    """(doc_id, chars, list_share, link_share, replicated_share, repeated_share, stuffed) for every page with list matter.

    documents(doc_id, site, text). list_share is of the page, the other shares are of its list matter: in lines with
    links; in phrases that at least ``hosts`` distinct hosts carry, anywhere in their pages; in stretches repeated within
    the page. stuffed where list_share exceeds ``density`` and one of the others reaches ``evidence``. Pages without list
    matter, null and empty texts have no row. A null site is a host of its own. Repeated rows are judged alike and kept.

    Phrases are counted in two steps, (phrase, host) and phrase, both partly summed before the shuffle, so no frequent
    phrase and no large host gathers in one task. Only phrases of dense pages are looked up again.
    """
    units = checkpointed(list_units(documents, words))
    every = units.select(F.coalesce("site", F.lit("")).alias("site"), F.explode("phrases").alias("h"))
    wide = every.groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= hosts).select("h")
    pages = units.where("listed > 0")
    dense = pages.where(F.col("listed") > density * F.col("chars"))
    # a page delivered twice under one id is one page here
    own = dense.groupBy("doc_id").agg(F.max(F.struct("phrases", "covers")).alias("p")).select("doc_id", F.explode(F.arrays_zip("p.phrases", "p.covers")).alias("x"))
    carried = own.select("doc_id", F.col("x.phrases").alias("h"), F.col("x.covers").alias("n")).where("n > 0")
    known = carried.join(wide, "h", "left_semi").groupBy("doc_id").agg(F.sum("n").alias("known"))
    covered = F.aggregate("covers", F.lit(0).cast("long"), lambda a, x: a + x)
    joined = pages.withColumn("covered", covered).drop("phrases", "covers").join(known, "doc_id", "left")
    shares = joined.select(
        "doc_id",
        "chars",
        (F.col("listed") / F.col("chars")).alias("list_share"),
        (F.col("linked") / F.col("listed")).alias("link_share"),
        F.when(F.col("covered") > 0, F.least(F.lit(1.0), F.coalesce("known", F.lit(0)) / F.col("covered"))).otherwise(0.0).alias("replicated_share"),
        F.col("again").alias("repeated_share"),
    )
    proof = F.greatest("link_share", "replicated_share", "repeated_share") >= evidence
    return shares.withColumn("stuffed", (F.col("list_share") > density) & proof)
