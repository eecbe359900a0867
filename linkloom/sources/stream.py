"""The broadcast that a transport stream was recorded from, read from samples of the file.

Tables of the stream become one record: the programme of the association table, its service's name, and the present event
that holds at every clock read. All samples must agree; anything else is no answer. Packets, sections and text follow the
public standards of MPEG-2 systems and ARIB (B10, B24).
"""

from __future__ import annotations

import datetime
import os

import pandas as pd
from pyspark.sql import DataFrame

SAMPLE = 8 << 20
JST = datetime.timezone(datetime.timedelta(hours=9))
VIDEO = {0x01, 0x02, 0x10, 0x1B, 0x24}
FIELDS = ["network_id", "transport_id", "service_id", "event_id", "channel", "name", "description", "started_at", "ended_at"]


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def mpeg_crc(data: bytes) -> int:
    """CRC-32 as MPEG-2 sections carry it (not reflected); 0 over a section with its checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def packet_layout(data: bytes) -> tuple[int, int] | None:
    """(stride, offset) at which five packets in a row begin."""
    for stride in (188, 192, 204):
        for offset in range(min(stride, max(0, len(data) - 4 * stride))):
            if all(data[offset + k * stride] == 0x47 for k in range(5)):
                return stride, offset
    return None


def sections(data: bytes, wanted: set[int]):
    """(pid, section) of every whole section with a right checksum on the wanted pids; gaps in the count drop what was begun."""
    layout = packet_layout(data)
    if layout is None:
        return
    stride, offset = layout
    held: dict[int, bytearray] = {}
    last: dict[int, tuple[int, bytes]] = {}
    for at in range(offset, len(data) - 187, stride):
        p = data[at : at + 188]
        if p[0] != 0x47 or p[1] & 0x80:
            continue
        pid = (p[1] & 0x1F) << 8 | p[2]
        if pid not in wanted or p[3] & 0xC0 or not p[3] & 0x10:
            continue
        count = p[3] & 0x0F
        if last.get(pid) == (count, p):
            continue  # a packet sent twice
        if pid in last and (last[pid][0] + 1) & 0x0F != count:
            held.pop(pid, None)
        last[pid] = count, p
        body = p[4:]
        if p[3] & 0x20:
            body = body[1 + body[0] :]
        if not body:
            continue
        if p[1] & 0x40:
            pointer = body[0]
            if pid in held:
                held[pid] += body[1 : 1 + pointer]
                yield from _finish(pid, held)
            held[pid] = bytearray(body[1 + pointer :])
        elif pid in held:
            held[pid] += body
        else:
            continue
        yield from _finish(pid, held)


def _finish(pid: int, held: dict[int, bytearray]):
    while pid in held:
        b = held[pid]
        if b and b[0] == 0xFF:
            held.pop(pid)
            return
        if len(b) < 3 or len(b) < (size := 3 + ((b[1] & 0x0F) << 8 | b[2])):
            return
        section = bytes(b[:size])
        del b[:size]
        if not section[1] & 0x80 or mpeg_crc(section) == 0:
            yield pid, section


def _descriptors(b: bytes):
    i = 0
    while i + 2 <= len(b) and i + 2 + b[i + 1] <= len(b):
        yield b[i], b[i + 2 : i + 2 + b[i + 1]]
        i += 2 + b[i + 1]


def _u16(b: bytes, i: int) -> int:
    return b[i] << 8 | b[i + 1]


def _bcd(b: int) -> int:
    if b >> 4 > 9 or b & 15 > 9:
        raise ValueError("no decimal digits")
    return (b >> 4) * 10 + (b & 15)


def stream_time(b: bytes) -> datetime.datetime:
    """Modified Julian day and three bytes of decimal digits, UTC+9."""
    day = datetime.date(1858, 11, 17) + datetime.timedelta(days=_u16(b, 0))
    return datetime.datetime(day.year, day.month, day.day, _bcd(b[2]), _bcd(b[3]), _bcd(b[4]), tzinfo=JST)


# Final bytes that designate a set of characters.
_SETS = {0x42: "kanji", 0x39: "kanji", 0x4A: "ascii", 0x36: "ascii", 0x30: "hiragana", 0x37: "hiragana", 0x31: "katakana", 0x38: "katakana", 0x49: "halfwidth", 0x3B: "extra"}
# The last cells of the kana sets.
_KANA_END = {0x77: ("ゝ", "ヽ"), 0x78: ("ゞ", "ヾ"), 0x79: "ー", 0x7A: "。", 0x7B: "「", 0x7C: "」", 0x7D: "、", 0x7E: "・"}
# The signs of row 90 of the broadcasting standard, from 0x7A50 on.
_ROW_90 = "[HV] [SD] [P] [W] [MV] [手] [字] [双] [デ] [S] [二] [多] [解] [SS] [B] [N] ■ ● [天] [交] [映] [無] [料] [年齢制限] [前] [後] [再] [新] [初] [終] [生] [販] [声] [吹] [PPV] (秘) ほか".split()
_SIGNS = {0x7A50 + i: sign for i, sign in enumerate(_ROW_90)}


def decode_text(data: bytes) -> str:
    """Text of the 8-unit code; ValueError where anything in it is unknown, as half a title is no evidence."""
    g = ["kanji", "ascii", "hiragana", "katakana"]
    left, right, single = 0, 2, None
    out, i = [], 0
    while i < len(data):
        b = data[i]
        if b == 0x1B:
            i += 1
            if i >= len(data):
                raise ValueError("cut escape")
            c = data[i]
            if c in (0x6E, 0x6F):
                left = 2 if c == 0x6E else 3
            elif c in (0x7C, 0x7D, 0x7E):
                right = {0x7E: 1, 0x7D: 2, 0x7C: 3}[c]
            else:
                slot = 0
                if c == 0x24:
                    i += 1
                    c = data[i] if i < len(data) else 0
                if 0x28 <= c <= 0x2B:
                    slot = c - 0x28
                    i += 1
                    c = data[i] if i < len(data) else 0
                if c not in _SETS:
                    raise ValueError("unknown set")
                g[slot] = _SETS[c]
            i += 1
            continue
        if b in (0x0E, 0x0F):
            left = 1 if b == 0x0E else 0
        elif b in (0x19, 0x1D):
            single = 2 if b == 0x19 else 3
        elif b in (0x0D, 0x0A):
            out.append("\n")
        elif b in (0x20, 0xA0):
            out.append(" ")
        elif b in (0x89, 0x8A):
            pass  # middle and normal size
        elif 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFE:
            kind = g[single if single is not None and b < 0x80 else left if b < 0x80 else right]
            single = None
            low = b & 0x7F
            if kind in ("kanji", "extra"):
                i += 1
                if i >= len(data):
                    raise ValueError("half a character")
                code = low << 8 | data[i] & 0x7F
                if code in _SIGNS:
                    out.append(_SIGNS[code])
                else:
                    out.append(bytes([low | 0x80, data[i] | 0x80]).decode("euc_jp"))
            elif kind == "ascii":
                out.append(chr(low))
            elif kind == "halfwidth":
                out.append(chr(0xFF61 + low - 0x21) if low <= 0x5F else "")
            elif low in _KANA_END:
                end = _KANA_END[low]
                out.append(end if isinstance(end, str) else end[kind == "katakana"])
            else:
                out.append(chr((0x3041 if kind == "hiragana" else 0x30A1) + low - 0x21))
        else:
            raise ValueError(f"unknown control {b:#x}")
        i += 1
    if single is not None:
        raise ValueError("a single shift without a character")
    return "".join(out)


def probe(data: bytes) -> dict | None:
    """The present event of a sample, or None where the tables miss or contradict each other."""
    programs: set[tuple[int, int, int]] = set()
    services: dict[tuple[int, int], str] = {}
    events: dict[tuple, dict] = {}
    clocks: list[datetime.datetime] = []
    pmts: set[int] = set()
    try:
        for pid, s in sections(data, {0x00, 0x11, 0x12, 0x14}):
            if pid == 0x00 and s[0] == 0x00 and s[5] & 1:
                for i in range(8, len(s) - 4, 4):
                    if _u16(s, i):
                        programs.add((_u16(s, 3), _u16(s, i), _u16(s, i + 2) & 0x1FFF))
                        pmts.add(_u16(s, i + 2) & 0x1FFF)
            elif pid == 0x11 and s[0] == 0x42 and s[5] & 1:
                i = 11
                while i + 5 <= len(s) - 4:
                    size = _u16(s, i + 3) & 0x0FFF
                    for tag, d in _descriptors(s[i + 5 : i + 5 + size]):
                        if tag == 0x48 and len(d) > 2:
                            n = d[1]
                            services[(_u16(s, 3), _u16(s, i))] = decode_text(d[3 + n : 3 + n + d[2 + n]])
                    i += 5 + size
            elif pid == 0x12 and s[0] == 0x4E and s[5] & 1 and s[6] == 0 and len(s) > 30:
                size = _u16(s, 24) & 0x0FFF
                start = stream_time(s[16:21])
                took = datetime.timedelta(hours=_bcd(s[21]), minutes=_bcd(s[22]), seconds=_bcd(s[23]))
                shorts = [d for tag, d in _descriptors(s[26 : 26 + size]) if tag == 0x4D and d[:3] == b"jpn"]
                if len(shorts) == 1:
                    d = shorts[0]
                    n = d[3]
                    e = {"network_id": _u16(s, 10), "transport_id": _u16(s, 8), "service_id": _u16(s, 3), "event_id": _u16(s, 14)}
                    e |= {"name": decode_text(d[4 : 4 + n]), "description": decode_text(d[5 + n : 5 + n + d[4 + n]]), "started_at": start, "ended_at": start + took}
                    events[tuple(e.values())] = e
            elif pid == 0x14 and s[0] in (0x70, 0x73) and len(s) >= 8:
                clocks.append(stream_time(s[3:8]))
    except (ValueError, IndexError, UnicodeDecodeError):
        return None
    if len({(t, p) for t, p, _ in programs}) != 1 or not clocks:
        return None
    transport, program, pmt = next(iter(programs))
    video = False
    for _, s in sections(data, {pmt}):
        if s[0] == 0x02 and _u16(s, 3) == program:
            i = 12 + (_u16(s, 10) & 0x0FFF)
            while i + 5 <= len(s) - 4:
                video = video or s[i] in VIDEO
                i += 5 + (_u16(s, i + 3) & 0x0FFF)
    mine = [e for e in events.values() if e["service_id"] == program and e["transport_id"] == transport]
    if len(mine) != 1 or (transport, program) not in services or not video:
        return None
    e = mine[0]
    if not all(e["started_at"] <= c < e["ended_at"] for c in clocks):
        return None
    return e | {"channel": services[(transport, program)]}


def read_broadcast(path: str, sample: int = SAMPLE) -> dict | None:
    """The broadcast on which the samples of a file (the middle of each third, or all of a small file) agree."""
    size = os.path.getsize(path)
    spans = [(0, size)] if size <= 3 * sample else [(k * size // 3 + (size // 3 - sample) // 2, sample) for k in range(3)]
    found = []
    with open(path, "rb") as file:
        for at, n in spans:
            file.seek(at)
            found.append(probe(file.read(n)))
    if os.path.getsize(path) != size or any(f is None or f != found[0] for f in found):
        return None
    return found[0]


SCHEMA = "path string, network_id int, transport_id int, service_id int, event_id int, channel string, name string, description string, started_at timestamp, ended_at timestamp"


def broadcasts(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The broadcasts of files(path): one row for each that tells one. Only samples are read, on the executors."""

    def scan(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    b = read_broadcast(path, sample)
                except OSError:
                    b = None
                if b is not None:
                    rows.append([path, *[b[k] for k in FIELDS]])
            yield pd.DataFrame(rows, columns=["path", *FIELDS])

    return files.select("path").where("path is not null").mapInPandas(scan, SCHEMA)
