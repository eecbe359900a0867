import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from linkloom.sources import files, stream, wire
from linkloom.streaming import arriving, link_arriving


def test_files(spark, tmp_path):
    for name in ("b.TS", "a.mp4", "x.txt", "sub/c.mkv", "backup/d.mp4"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    os.symlink(tmp_path / "a.mp4", tmp_path / "link.mp4")
    names = lambda df: [os.path.relpath(r["path"], tmp_path) for r in df.collect()]
    assert names(files.recordings(spark, str(tmp_path))) == ["a.mp4", "b.TS"]
    assert names(files.recordings(spark, str(tmp_path), recursive=True)) == ["a.mp4", "b.TS", "sub/c.mkv"]
    assert files.recordings_in_store(spark, str(tmp_path)).count() >= 4
    jobs = spark.createDataFrame([("/w/a.ts", 1), ("/w/duplicate/a (1).ts", 1), ("/v/a.ts", 1), ("/v/b.ts", 2), ("/u/x.ts", None)], "path string, work_id int")
    assert sorted(tuple(r) for r in files.folder_works(jobs).collect()) == [("/v", None, 2), ("/w", 1, 1)]
    nfo = '<tvshow><uniqueid type="other">5</uniqueid><uniqueid type="catalogue">7</uniqueid></tvshow>'
    side = spark.createDataFrame([("a", nfo, '{"work_id": 7}'), ("b", nfo, '{"work_id": 8}'), ("c", None, None), ("d", None, '{"work_id": 3}')], "folder string, nfo string, json string")
    assert sorted(tuple(r) for r in files.sidecar_identity(side, "catalogue").collect()) == [("a", 7, 1), ("b", None, 2), ("d", 3, 1)]


def test_wire(spark):
    node = {"annictId": 1, "title": "海", "media": "TV", "syobocalTid": 9, "seasonName": "SPRING", "seasonYear": 2020, "episodesCount": 2, "episodes": {"pageInfo": {"hasNextPage": False}, "edges": [{"node": {"annictId": 5, "number": "1.5", "numberText": "第1.5話", "sortNumber": 15, "title": "間"}}, {"node": {"annictId": 6, "number": 2, "sortNumber": 20}}, {"node": {"annictId": 7, "number": "x", "sortNumber": 30}}]}}
    body = json.dumps({"data": {"searchWorks": {"pageInfo": {"hasNextPage": False}, "edges": [{"node": node}, {"node": node}]}}})
    works, episodes = wire.search_results(spark.createDataFrame([(body,), (body,)], "body string"))
    assert [(r["id"], r["season_name"], r["whole"]) for r in works.collect()] == [(1, "2020-spring", True)]
    assert sorted((r["id"], r["number"], r["malformed"]) for r in episodes.collect()) == [(5, 1.5, False), (6, 2.0, False), (7, None, True)]
    xml = "<R><ProgItems><ProgItem><PID>3</PID><TID>9</TID><ChID>1</ChID><Count>2</Count><StTime>2026-08-01 00:30:00</StTime><EdTime>2026-08-01 01:00:00</EdTime><SubTitle>窓</SubTitle><Deleted>0</Deleted><Warn>1</Warn></ProgItem><ProgItem><PID>4</PID><TID>8</TID></ProgItem></ProgItems><Result><Code>200</Code></Result></R>"
    rows = {r["pid"]: r for r in wire.schedule_rows(spark.createDataFrame([(9, xml), (7, "<R><Result><Code>404</Code></Result></R>")], "tid int, body string")).collect()}
    assert set(rows) == {3, 4} and rows[4]["foreign"] and not rows[3]["foreign"] and rows[3]["warn"] and rows[3]["started_at"] == datetime.datetime(2026, 7, 31, 15, 30)
    channels = wire.schedule_channels(spark.createDataFrame([("<R><ChItems><ChItem><ChID>1</ChID><ChName>局</ChName></ChItem></ChItems></R>",)], "body string"))
    assert [tuple(r) for r in channels.collect()] == [(1, "局")]
    page = lambda total, *ids: json.dumps({"total": total, "records": [{"id": i, "name": "x", "videoFiles": [{"filename": "a.ts"}]} for i in ids]})
    found = wire.history_records(spark.createDataFrame([("s", page(3, 1, 2)), ("s", page(3, 3)), ("t", page(2, 1)), ("u", page(2, 1, 1))], "search string, body string"))
    assert {(r["search"], r["whole"]) for r in found.collect()} == {("s", True), ("t", False), ("u", False)}


def section(table, ext, body, current=1):
    size = len(body) + 9
    head = bytes([table, 0xB0 | size >> 8, size & 255, ext >> 8, ext & 255, 0xC0 | current, 0, 0]) + body
    return head + stream.mpeg_crc(head).to_bytes(4, "big")


def packets(pid, data, start=0):
    out, first, n = b"", True, start
    data = b"\0" + data
    while data:
        chunk, data = data[:184], data[184:]
        out += bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 255, 0x10 | n & 15]) + chunk + b"\xff" * (184 - len(chunk))
        first, n = False, n + 1
    return out


def arib(text):
    return text.encode("euc_jp").translate(bytes(b & 0x7F for b in range(256)))


def transport(name="夜の海", clock=0x30, video=0x02, service=101):
    mjd = (datetime.date(2026, 8, 1) - datetime.date(1858, 11, 17)).days.to_bytes(2, "big")
    named = arib(name)
    short = b"jpn" + bytes([len(named)]) + named + bytes([2]) + arib("窓")
    descriptor = bytes([0x4D, len(short)]) + short
    eit = (7).to_bytes(2, "big") + (4).to_bytes(2, "big") + bytes([0, 0x4E]) + (55).to_bytes(2, "big") + mjd + bytes([0x23, 0x30, 0, 0, 0x30, 0]) + (0x8000 | len(descriptor)).to_bytes(2, "big") + descriptor
    title = arib("局")
    sdesc = bytes([0x48, 3 + len(title), 1, 0, len(title)]) + title
    sdt = (4).to_bytes(2, "big") + b"\xff" + (service).to_bytes(2, "big") + b"\xff" + (0x8000 | len(sdesc)).to_bytes(2, "big") + sdesc
    pat = (101).to_bytes(2, "big") + (0xE000 | 0x100).to_bytes(2, "big")
    pmt = (0xE000 | 0x111).to_bytes(2, "big") + b"\xf0\0" + bytes([video]) + (0xE000 | 0x111).to_bytes(2, "big") + b"\xf0\0"
    tdt = bytes([0x70, 0x70, 5]) + mjd + bytes([0x23, clock, 0])
    return packets(0, section(0, 7, pat)) + packets(0x100, section(2, 101, pmt)) + packets(0x11, section(0x42, 7, sdt)) + packets(0x12, section(0x4E, 101, eit)) + packets(0x14, tdt)


def test_transport_streams(spark, tmp_path):
    good = transport()
    b = stream.probe(good)
    assert (b["channel"], b["name"], b["description"], b["event_id"]) == ("局", "夜の海", "窓", 55)
    assert b["started_at"] == datetime.datetime(2026, 8, 1, 23, 30, tzinfo=stream.JST) and b["ended_at"] - b["started_at"] == datetime.timedelta(minutes=30)
    assert stream.probe(transport(clock=0x10)) is None and stream.probe(transport(video=0x0F)) is None and stream.probe(transport(service=9)) is None
    assert stream.probe(good[:-376]) is None and stream.probe(b"") is None and stream.probe(good[:200] + bytes([good[200] ^ 0xFF]) + good[201:]) is None
    long = transport("海" * 120)
    assert stream.probe(long)["name"] == "海" * 120
    wide = b"".join(b"\0\0\0\0" + good[i : i + 188] for i in range(0, len(good), 188))
    assert stream.probe(wide)["name"] == "夜の海"
    assert stream.decode_text(b"\x0e" + b"ABC" + b"\x0f" + arib("海") + b"\xa2\xf9") == "ABC海あー"
    (tmp_path / "a.ts").write_bytes(good)
    (tmp_path / "b.ts").write_bytes(good + transport("ちがう"))
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.ts", "b.ts", "none.ts")], "path string")
    rows = stream.broadcasts(paths).collect()
    assert [(os.path.basename(r["path"]), r["name"]) for r in rows] == [("a.ts", "夜の海")]


def test_streaming(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    line = {"path": "/r/遠い海 #1「窓辺」.ts", "seen_at": "2026-08-01T00:00:00Z"}
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(x) for x in (line, line)))
    works = spark.createDataFrame([(1, "遠い海", "tv", "2026-summer", "11", 1)], "id int, title string, media string, season_name string, syobocal_tid string, episodes_count int")
    episodes = spark.createDataFrame([(10, 1, 1.0, "第1話", 10, "窓辺")], "id int, work_id int, number double, number_text string, sort_number int, title string")
    programs = spark.createDataFrame([], "pid int, tid int, count int, t long, deleted boolean, warn boolean")
    q = link_arriving(arriving(spark, str(tmp_path / "in")), works, episodes, programs, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).where(F.col("status") == "linked").collect()
    assert [(r["episode_id"], r["target"]) for r in out] == [(10, "/r/遠い海/遠い海 #1 「窓辺」.ts")]


def test_broadcast_signs():
    row = lambda *cells: b"".join(bytes([0x7A, c]) for c in cells)
    assert stream.decode_text(row(0x56, 0x65, 0x6A, 0x6B, 0x6C, 0x6D, 0x6E)) == "[字][無][再][新][初][終][生]"
    assert stream.decode_text(row(0x50, 0x60, 0x62, 0x63, 0x64, 0x67, 0x68, 0x69, 0x73, 0x74)) == "[HV]■[天][交][映][年齢制限][前][後](秘)ほか"
    # katakana and hiragana on the right, Latin letters and kanji by shifts on the left
    assert stream.decode_text(bytes.fromhex("1b7ca2cb1b7dcf0e410f2126")) == "アニはA・"
    for bad in ("1b", "1b282040", "21", "7a7e", "95", "1d", "1b243a2121"):
        with pytest.raises(ValueError):
            stream.decode_text(bytes.fromhex(bad))


def test_paged_answers(spark):
    page = lambda search, total, *ids: (search, json.dumps({"works": [{"id": i, "title": f"t{i}"} for i in ids], "total_count": total}))
    answers = [page("a", 3, 1, 2), page("a", 3, 3), page("b", 2, 1, 1), page("c", 2, 1), page("d", 1, 0), page("e", 2, 1), page("e", 3, 2), ("f", "no json"), page("g", 0)]
    found = wire.works_of_pages(spark.createDataFrame(answers, "search string, body string"))
    rows = found.collect()
    assert sorted(r["id"] for r in rows if r["search"] == "a") == [1, 2, 3] and all(r["refused"] is None for r in rows if r["search"] == "a")
    assert {r["search"]: r["refused"] for r in rows if r["search"] != "a"} == {"b": "duplicate", "c": "incomplete", "d": "invalid", "e": "total", "f": "total"}
    second = wire.works_of_pages(spark.createDataFrame([page("a", 1, 9), page("b", 1, 8), page("g", 1, 7)], "search string, body string"))
    assert sorted((r["search"], r["id"]) for r in wire.first_answering(found, second).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 8), ("g", 7)]
    body = json.dumps({"episodes": [{"id": 5, "number": 1.5, "sort_number": 1}, {"id": 6, "number": "x"}, {"id": 7, "number": None}], "total_count": 3})
    assert sorted((r["id"], r["work_id"], r["number"], r["refused"]) for r in wire.episodes_of_pages(spark.createDataFrame([("4", body)], "search string, body string")).collect()) == [(5, 4, 1.5, None), (6, 4, None, "invalid"), (7, 4, None, None)]
    at = lambda i, t: {"id": i, "started_at": t, "work": {"id": 4}, "episode": {"id": 5}}
    body = json.dumps({"programs": [at(1, "2026-08-01T00:00:00+09:00"), at(2, "2026-07-31T15:00:01Z"), at(3, "2026-08-02T00:00:00Z")], "total_count": 3})
    assert [r["id"] for r in wire.programs_between(spark.createDataFrame([("4", body)], "search string, body string"), "2026-07-31T15:00:00Z", "2026-08-02T00:00:00Z").collect()] == [2]


def test_copies_are_numbered_on_in_later_batches(spark, tmp_path):
    works = spark.createDataFrame([(1, "遠い海", None, "tv", None, None, None, None, None, 1, 0)], "id int, title string, title_kana string, media string, media_text string, season_name string, season_name_text string, released_on string, syobocal_tid string, episodes_count int, watchers_count int")
    episodes = spark.createDataFrame([(10, 1, 1.0, "第1話", 10, "窓辺")], "id int, work_id int, number double, number_text string, sort_number int, title string")
    programs = spark.createDataFrame([], "tid int, count int, t long, deleted boolean, warn boolean")
    os.makedirs(tmp_path / "in")
    for k, name in enumerate(["遠い海 #1「窓辺」.ts", "遠い海 #1「窓辺」[再].ts"]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"path": f"/r/{name}", "seen_at": f"2026-08-01T00:0{k}:00Z"}))
        link_arriving(arriving(spark, str(tmp_path / "in")), works, episodes, programs, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = {r["target"] for r in spark.read.parquet(str(tmp_path / "out")).where("target is not null").collect()}
    assert out == {"/r/遠い海/遠い海 #1 「窓辺」.ts", "/r/遠い海/duplicate/遠い海 #1 「窓辺」 (1).ts"}
