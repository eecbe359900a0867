"""Text that was decoded with a wrong character encoding: found, and restored where nothing is lost.

A text is a node of a graph; its edges are repairs: encode with one charset and decode with another, read stripped
escape sequences again, unescape references. A best-first search with visited states starts at the text as it is, always
expands the most plausible text found so far, and ends at the cheapest one reachable. Plausibility is a cost summed over
characters, by class and neighbourhood. A text is garbled where the search finds a clearly cheaper one, where single
letters of it are whole in UTF-8 and leave sound text, or where it holds characters that no sound text has and that no
repair removes.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Charsets that text is wrongly read in, and those that it was written in.
READ_AS = ["latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "cp437", "mac-roman", "cp932", "gb18030"]
WRITTEN_IN = ["utf-8", "cp932", "euc_jp"]
#: Texts expanded at most for one value; a search that this ends is reported (``searched`` false).
MAX_STATES = 400
#: What a repair must save to count, in all and as a share of the cost; letters that are whole in UTF-8 need not (``letters_restored``).
MIN_GAIN, MIN_SHARE = 3.0, 0.12
#: Mass of impossible characters at which a text counts as garbled beyond repair.
MIN_MASS = 3.0

_STRIPPED = re.compile(r"\x1b?\$[@B]((?:[!-~]{2})+?)\x1b?\([BJ]")
_REFERENCE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8}\d?);")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){2,}")
_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4}){2,}|(?:\\x[0-9a-fA-F]{2}){2,}")
_UTF8_RUN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")


def base_cost(ch: str) -> tuple[float, str]:
    """Cost of a character in good company, and its class."""
    c = ord(ch)
    if c < 0x80:
        return (0.3, "a") if ch.isalpha() else (0.3, "0") if ch in "\n\r\t" or c >= 0x20 and c != 0x7F else (8.0, "!")
    if c < 0xA0:
        return 8.0, "!"
    if 0x3041 <= c <= 0x3096:
        return 0.3, "h"
    if 0x30A1 <= c <= 0x30FF:
        return 0.35, "k"
    if 0xFF21 <= c <= 0xFF3A or 0xFF41 <= c <= 0xFF5A:
        return 0.4, "a"
    if 0x3000 <= c <= 0x303F or 0xFF01 <= c <= 0xFF5E or c == 0xFFE5:
        return 0.4, "p"
    if 0xFF61 <= c <= 0xFF9F:
        return (0.9 if c < 0xFF66 else 0.6), "w"
    if 0x4E00 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF:
        try:
            b = ch.encode("cp932")
        except UnicodeEncodeError:
            return 4.0, "x"
        # the first level of the standard ends at 0x9872
        return (0.8, "c") if b < b"\x98\x73" else (2.5, "r")
    if 0x3400 <= c <= 0x4DBF or c > 0x1FFFF:
        return 4.0, "x"
    if c == 0xFFFD or 0xE000 <= c <= 0xF8FF:
        return 6.0, "!"
    if 0x2500 <= c <= 0x259F:
        return 3.5, "s"
    if 0x0370 <= c <= 0x03FF or 0x1F00 <= c <= 0x1FFF:
        return (0.5, "g") if unicodedata.category(ch)[0] == "L" else (2.5, "s")
    if 0x0400 <= c <= 0x04FF:
        return (0.5, "y") if 0x0410 <= c <= 0x044F or c in (0x401, 0x451) else (1.2, "y")
    kind = unicodedata.category(ch)
    if kind == "Cf":
        return 0.5, "i"
    if kind[0] == "M":
        return 0.6, "m"
    if kind[0] == "L":
        return (0.5, "l") if c < 0x250 else (2.5, "o")
    if kind == "Zs":
        return 0.6, "i"
    if c < 0x100:
        return 2.8, "s"
    if 0x2010 <= c <= 0x2027 or 0x2030 <= c <= 0x203E or 0x2190 <= c <= 0x27BF:
        return 0.9, "u"
    return 2.8, "s"


class _Sign(dict):
    """By code point: one sign for each (cost, class), so that texts are classified by ``str.translate``."""

    def __init__(self) -> None:
        super().__init__()
        self.of: dict[tuple[float, str], str] = {}
        self.cost: dict[str, float] = {}
        self.kind: dict[str, str] = {}

    def __missing__(self, code: int) -> str:
        key = base_cost(chr(code))
        if key not in self.of:
            sign = chr(0x100 + len(self.of))
            self.of[key], self.cost[sign], self.kind[sign] = sign, *key
        self[code] = self.of[key]
        return self[code]


_SIGNS = _Sign()
#: Classes of characters that need no look at their neighbours, and those that nothing about is unusual.
_QUIET, _SOUND = frozenset("a0hkpcwrxoim"), frozenset("a0hkpc")


@lru_cache(maxsize=4_096)
def cost_and_mass(text: str) -> tuple[float, float]:
    """(cost of a text, mass of characters that no sound text has).

    Letters of a foreign alphabet are cheap only in a word of their own script, accented ones only beside plain letters;
    signs that decoding leaves behind (quotes, daggers, currency signs) are dear beside such letters.
    """
    signs = text.translate(_SIGNS)
    of = _SIGNS.kind
    cost, noisy = 0.0, []
    for s in set(signs):
        cost += signs.count(s) * _SIGNS.cost[s]
        if of[s] not in _QUIET:
            noisy.append(s)
    mass = 0.0
    n = len(signs)
    for m in re.finditer("[" + "".join(noisy) + "]", signs) if noisy else ():
        i = m.start()
        k = of[m[0]]
        if k == "!":
            mass += 4.0
            continue
        before = of[signs[i - 1]] if i else "0"
        after = of[signs[i + 1]] if i + 1 < n else "0"
        if k == "s":
            mass += 1.0
        elif k == "u":
            if before in "ys!" or after in "ys!":
                cost += 1.5
                mass += 1.0
            elif before == "l" or after == "l":
                cost += 1.0
                mass += 0.3
        else:
            good = (k,) if k in "gy" else ("l", "a", "m")
            if k == "l" and before == "l" and after == "l":
                cost += 1.5  # a row of accented letters
                mass += 0.7
            elif before not in good and after not in good:
                cost += 2.0
                mass += 0.7
            elif k in "gy" and (before in "s!aw" or after in "s!aw"):
                cost += 0.8
    return cost, mass


def unusual(text: str) -> bool:
    """Whether a text has any character besides ASCII, kana, common kanji and their punctuation.

    A repair reads bytes again; bytes of text in any charset here, taken for another, give at least one such character:
    common kanji alone lie in rows of their charsets whose bytes begin no character of UTF-8, and between charsets of two
    bytes a kanji becomes a kanji, which is never cheaper than a common one.
    """
    return any(_SIGNS.kind[s] not in _SOUND for s in set(text.translate(_SIGNS)))


def written_out(text: str) -> bool:
    """Whether a text holds references, escapes or sequences whose introducer was lost."""
    return any(p.search(text) for p in (_STRIPPED, _REFERENCE, _PERCENT, _ESCAPE))


def mostly_lost(text: str) -> bool:
    """Question marks, four at least, that make up half of a text: what a charset without its letters leaves."""
    return text.count("?") >= 4 and 2 * text.count("?") >= sum(not c.isspace() for c in text)


@lru_cache(maxsize=None)
def _single_byte(charset: str) -> dict[str, bytes] | None:
    """The bytes of a single-byte charset by character; bytes without one stand for the control of their number."""
    if charset in ("cp932", "gb18030"):
        return None
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, bytes([b]))
    if charset == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), bytes([b]))
    return out


@lru_cache(maxsize=100_000)
def _bytes_of(ch: str, charset: str) -> bytes | None:
    table = _single_byte(charset)
    if table is not None:
        return table.get(ch)
    if charset == "cp932":
        special = {"": b"\xa0", "": b"\xfd", "": b"\xfe", "": b"\xff"}.get(ch)
        if special:
            return special
        if "\x80" <= ch < "\xa0":
            return bytes([ord(ch)])
    try:
        return ch.encode(charset)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=None)
def _charset(name: str) -> tuple[re.Pattern | None, dict[int, str] | None]:
    """(runs of characters that a charset has, its bytes as code points by character); None for all characters, or for more than one byte."""
    table = _single_byte(name)
    if table is not None:
        return re.compile("[" + re.escape("".join(table)) + "]+"), {ord(ch): chr(b[0]) for ch, b in table.items()}
    if name == "gb18030":
        return re.compile("[^\ud800-\udfff]+"), None
    known = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and _bytes_of(chr(c), name) is not None]
    spans: list[list[int]] = []
    for c in known:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "]+"), None


def _segments(text: str, charset: str) -> list[tuple[int, int, bytes]]:
    """Maximal runs of characters that the charset has, with at least one beyond ASCII: (start, end, bytes)."""
    runs, table = _charset(charset)
    out = []
    for m in runs.finditer(text):
        run = m[0]
        if run.isascii() or table is None and not unusual(run):
            continue
        if table is not None:
            whole = run.translate(table).encode("latin-1")
        else:
            try:
                whole = run.encode(charset)
            except UnicodeEncodeError:
                whole = b"".join(_bytes_of(ch, charset) for ch in run)
        if not whole.isascii():
            out.append((m.start(), m.end(), whole))
    return out


def _places(text: str, start: int, end: int, charset: str) -> dict[int, int] | range:
    """Place in the run of every character's first byte."""
    if _charset(charset)[1] is not None:
        return range(end - start + 1)
    edges, at = {0: 0}, 0
    for k in range(start, end):
        at += len(_bytes_of(text[k], charset))
        edges[at] = k + 1 - start
    return edges


def reread(text: str, read_as: str, written_in: str, segments: list[tuple[int, int, bytes]] | None = None) -> str | None:
    """``text`` with every part read again that fits; None where nothing changes.

    Sequences that are no whole characters of the other charset stay as they are, so that text garbled in part, or
    with bytes lost, is repaired where it can be.
    """
    out, last = [], 0
    for start, end, whole in _segments(text, read_as) if segments is None else segments:
        if written_in == "utf-8":
            edges = None
            for m in _UTF8_RUN.finditer(whole):
                edges = edges or _places(text, start, end, read_as)
                a, b = m.span()
                while a < b and a not in edges:
                    a += 1
                while a < b and whole[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b not in edges:
                    b -= 1
                if a >= b or a not in edges:
                    continue
                try:
                    fixed = whole[a:b].decode("utf-8")
                except UnicodeDecodeError as e:
                    b = a + e.start
                    if b <= a or b not in edges:
                        continue
                    fixed = whole[a:b].decode("utf-8")
                out += [text[last : start + edges[a]], fixed]
                last = start + edges[b]
        else:
            try:
                fixed = whole.decode(written_in)
            except UnicodeDecodeError:
                fixed = whole.decode(written_in, errors="replace")
                if fixed.count("\ufffd") * 3 > len(fixed):
                    continue
            out += [text[last:start], fixed]
            last = end
    if not out:
        return None
    out.append(text[last:])
    joined = "".join(out)
    return None if joined == text else joined


@lru_cache(maxsize=None)
def _letter_pairs() -> tuple[re.Pattern, dict[str, int]]:
    """Two characters that are one in UTF-8, read as Latin-1 or cp1252; and the bytes of the second."""
    low = {chr(b): b for b in range(0x80, 0xC0)} | {ch: b[0] for ch, b in _single_byte("cp1252").items() if 0x80 <= b[0] < 0xC0}
    return re.compile(f"([Â-ß])([{re.escape(''.join(low))}])"), low


def letters_restored(text: str) -> str:
    """``text`` with single letters (and signs of Latin-1) that were written in UTF-8 and read as Latin-1 or cp1252 restored.

    A capital at the end of a word before a closing sign, as in «RENÉ», is left: it may be meant.
    """
    pattern, low = _letter_pairs()

    def one(m: re.Match) -> str:
        ch = bytes([ord(m[1]), low[m[2]]]).decode("utf-8")
        before, after = text[: m.start()][-1:], text[m.end() :][:1]
        if m[2] in "»”’“‘›…–—™®©" and not after.isalpha() and (before.isupper() or m[1] not in "ÂÃ"):
            return m[0]
        c = ord(ch)
        fits = c < 0x100 or (c < 0x250 or 0x370 <= c < 0x460) and ch.isalpha()
        return ch if fits else m[0]

    return pattern.sub(one, text)


def _iso2022(m: re.Match) -> str:
    try:
        return (b"\x1b$B" + m[1].encode("ascii") + b"\x1b(B").decode("iso2022_jp")
    except UnicodeDecodeError:
        return m[0]


def _percent(m: re.Match) -> str:
    raw = bytes(int(x, 16) for x in m[0][1:].split("%"))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def neighbours(text: str):
    """(repair, text) for every repair that changes the text."""
    if _STRIPPED.search(text):
        yield "iso-2022-jp", _STRIPPED.sub(_iso2022, text)
    if _REFERENCE.search(text):
        yield "references", html.unescape(text)
    if _PERCENT.search(text):
        yield "percent", _PERCENT.sub(_percent, text)
    if _ESCAPE.search(text):
        yield "escapes", _ESCAPE.sub(lambda m: m[0].encode("latin-1").decode("unicode_escape"), text)
    for r in READ_AS:
        segments = _segments(text, r)
        for w in WRITTEN_IN if segments else ():
            if r != w:
                found, name = reread(text, r, w, segments), f"{r}>{w}"
                while found is not None:
                    yield name, found
                    # text garbled twice alike looks no better after one repair, so the second is tried at once
                    found, name = reread(found, r, w) if w == "utf-8" and r in ("latin-1", "cp1252") and name.count("+") < 2 else None, f"{name}+{r}>{w}"


def search(text: str) -> tuple[str, list[str], float, float, bool]:
    """(cheapest text reachable, repairs that lead to it, its cost, cost of ``text``, whether the search came to its end) by best-first search.

    Texts much dearer than the cheapest one found so far are not pursued, as a step of a repair that makes text much worse
    is none. The search ends where nothing is left to pursue, or where the cheapest text has nothing unusual, or little of it.
    """
    own = cost_and_mass(text)[0]
    seen = {hash(text)}
    queue = [(own, 0, text, ())]
    best = (own, text, ())
    expanded = count = 0
    while queue:
        cost, _, now, path = heapq.heappop(queue)
        if cost > 1.2 * best[0] + 4:
            break  # so is everything behind it
        if expanded == MAX_STATES:
            return best[1], list(best[2]), best[0], own, False
        expanded += 1
        for repair, found in neighbours(now):
            key = hash(found)
            if key in seen:
                continue
            seen.add(key)
            c = cost_and_mass(found)[0]
            count += 1
            heapq.heappush(queue, (c, count, found, (*path, repair)))
            if c < best[0] - 0.2:
                best = (c, found, (*path, repair))
        if best[2] and not written_out(best[1]) and (not unusual(best[1]) or best[0] <= 0.45 * len(best[1]) and cost_and_mass(best[1])[1] == 0):
            break
    return best[1], list(best[2]), best[0], own, True


def examine(text: str) -> tuple[bool, str, list[str], bool, bool]:
    """(garbled, text restored as far as possible, repairs, whether nothing of it is lost, whether the search came to its end)."""
    lost = mostly_lost(text)
    if not unusual(text) and not written_out(text):
        return lost, text, [], not lost, True
    own, mass = cost_and_mass(text)
    if lost:
        mass += MIN_MASS
    best, path, cost, _, ended = search(text)
    # escape sequences that read as text are no chance, however little they save beside much sound text
    enough = 0.2 if "iso-2022-jp" in path and cost_and_mass(best)[1] == 0 else max(MIN_GAIN, MIN_SHARE * min(own, 40))
    clear = bool(path) and own - cost >= enough
    found = letters_restored(text)
    # a lone sign as in "20Â°C" is one in UTF-8 rather than a kanji among plain characters
    lone = sum(ch > "\x7f" for ch in text) == 2 and not any("utf-8" in x for x in path)
    if found != text and (lone or not clear):
        now, left = cost_and_mass(found)
        if now < own and left < MIN_MASS:
            return True, found, ["letters>utf-8"], True, ended
    if clear:
        return True, best, path, cost_and_mass(best)[1] < 1, ended
    return mass >= MIN_MASS, text, [], mass < 1, ended


def find_garbled(records: DataFrame) -> DataFrame:
    """``records`` (any key columns, field, text) with garbled BOOLEAN, restored STRING, repairs ARRAY<STRING>, whole BOOLEAN, searched BOOLEAN.

    restored is the text itself where it is sound, else the most plausible text found, also where part of it stays lost
    (whole false); searched is false where MAX_STATES ended the search. Null texts give nulls, blank ones are sound. Rows are kept one to one, in place; texts are taken whole.
    """

    @F.pandas_udf("struct<garbled:boolean,restored:string,repairs:array<string>,whole:boolean,searched:boolean>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None:
                rows.append((None, None, None, None, None))
            else:
                rows.append(examine(text))
        out = pd.DataFrame(rows, columns=["garbled", "restored", "repairs", "whole", "searched"])
        return out.astype({"garbled": "object", "whole": "object", "searched": "object"})

    name = "__ll_judged"
    while name in records.columns:
        name += "_"
    keep = [F.col(f"`{c}`") for c in records.columns if c not in ("garbled", "restored", "repairs", "whole", "searched")]
    j = F.col(name)
    return records.withColumn(name, judged("text")).select(*keep, j["garbled"].alias("garbled"), j["restored"].alias("restored"), j["repairs"].alias("repairs"), j["whole"].alias("whole"), j["searched"].alias("searched"))
