from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions.names import fraction_label, kanji_value, parse_name, quoted, trailing_quote
from linkloom.operators.linking import LinkOptions, link, sidecars


def field(name, *keys):
    p = parse_name(name)
    return tuple(p[k] for k in keys)


def test_names():
    assert field("花園の夜明け 第2期 ep．7「ずっとそばに」 (20260813).mp4", "work_title", "episode_number", "subtitle") == ("花園の夜明け 第2期", 7, "ずっとそばに")
    assert field("/a/b/[字]遠い海 #03「窓辺」[再].ts", "work_title", "episode_number", "subtitle") == ("遠い海", 3, "窓辺")
    assert field("海 第8.50話「間」.ts", "episode_number", "episode_label") == (None, "8.5")
    assert field("海 最終話「終わり」.ts", "final_episode", "work_title") == (True, "海")
    assert field("海 第十二羽「月」.mkv", "episode_number") == (12,)
    assert field("【ふしぎ】第3話「x」.ts", "work_title") == ("【ふしぎ】",)
    for name, kind in (("海 第1話〜第3話.ts", "ambiguous"), ("海 #1,2.ts", "ambiguous"), ("海 (20261399).mp4", "date"), ("[字].ts", "empty"), ("", "empty"), ("海 全12話総集編.ts", "unsupported"), ("海 第0話.ts", "ambiguous")):
        assert field(name, "error_kind") == (kind,), name
    assert kanji_value("百二十三") == 123 and kanji_value("一〇") == 10 and kanji_value("十十") is None and kanji_value("") is None
    assert fraction_label("007", "50") == "7.5" and fraction_label("1", "00") is None
    assert quoted("x「a「b」c」d") == "a「b」c" and quoted("「開") is None and trailing_quote("題「副」") == ("題", "副") and trailing_quote("「題」") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_name_parses_or_is_refused(name):
    p = parse_name(name)
    assert (p["error"] is None) == (p["error_kind"] is None) == (p["work_title"] is not None)
    assert not (p["episode_number"] and p["episode_label"])


def test_keys():
    assert T.title_key("孤独な転校生 Trémolo (2024年版) 第二期") == T.title_key("孤独な転校生・Ｔｒéｍｏｌｏ Season 2")
    assert T.normalise("は゛ｶﾞ") == "ばガ" and T.normalise("フィルム") == "フイルム" and T.repair_dashes("カ―ド ―夜―") == "カード ―夜―"
    assert T.identity_key("第3話 窓辺！") == "窓辺" and T.scoring_key("Café・夜…") == "cafe・夜"
    assert T.without_readings("騎士(きし)の夜（前編）") == "騎士の夜（前編）"
    assert T.scoring_key("100-メートル") == T.scoring_key("100ーメートル") and T.scoring_key("寶の夜…♡") == "宝の夜"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(min_value=0, max_value=90))
def test_shortened_texts_fit(s, n):
    out = T.shorten(s, n)
    assert len(out.encode()) <= max(n, 0) and (out == s or out.endswith("…") or out == "")


def test_link(spark):
    works = spark.createDataFrame([(1, "遠い海", None, "tv", None, "2026-summer", None, None, "11", 3, 0), (2, "遠い海 第2期", None, "tv", None, "2026-autumn", None, None, None, 2, 0)], "id int, title string, title_kana string, media string, media_text string, season_name string, season_name_text string, released_on string, syobocal_tid string, episodes_count int, watchers_count int")
    episodes = spark.createDataFrame([(10, 1, 1.0, "第1話", 10, "窓辺"), (11, 1, 2.0, "第2話", 20, "灯台"), (12, 1, None, "第2.5話", 25, "間"), (13, 1, 3.0, None, 30, None), (20, 2, 1.0, "第1話", 10, "帆")], "id int, work_id int, number double, number_text string, sort_number int, title string")
    programs = spark.createDataFrame([(1, 11, 2, 1_784_200_000_000, False, False), (2, 11, 3, 1_784_300_000_000, False, False)], "pid int, tid int, count int, t long, deleted boolean, warn boolean")
    names = ["遠い海 #1「窓辺」.ts", "遠い海 #1「窓辺」 [再].ts", "遠い海 #2「ちがう」.ts", "遠い海 第2.5話「間」.ts", "遠い海 (20260716).ts", "ない題 #1.ts", "遠い海 第1話〜第3話.ts", "遠い海「灯台」.ts", "遠い海 #9.ts"]
    files = spark.createDataFrame([(i, f"/r/{n}") for i, n in enumerate(names)] + [(99, None)], "rec int, path string")
    out = {r["rec"]: r for r in link(files, works, episodes, programs).collect()}
    assert [out[i]["status"] for i in (*range(9), 99)] == ["linked", "linked", "below", "linked", "linked", "open", "refused", "linked", "open", "refused"]
    assert [out[i]["episode_id"] for i in (0, 2, 3, 4, 7)] == [10, 11, 12, 11, 11] and out[4]["strategy"] == "schedule" and out[4]["confidence"] == 90
    assert {out[0]["target"], out[1]["target"]} == {"/r/遠い海/遠い海 #1 「窓辺」.ts", "/r/遠い海/duplicate/遠い海 #1 「窓辺」 (1).ts"}
    assert out[2]["target"] is None and out[0]["confidence"] == 90
    moved = {r["rec"]: r for r in link(files.where("rec = 0"), works, episodes, programs, LinkOptions(output="/out")).collect()}
    assert moved[0]["target"] == "/out/遠い海/遠い海 #1 「窓辺」.ts"
    nfo = sidecars(link(files.where("rec = 0"), works, episodes, programs), works, episodes).collect()
    assert len(nfo) == 1 and "<showtitle>遠い海</showtitle>" in nfo[0]["nfo"]
    assert link(files.limit(0), works, episodes, programs).count() == 0


def test_link_by_trusted_channel_and_corroborated_rows(spark):
    works = spark.createDataFrame([(1, "遠い海", None, "tv", None, "2026-summer", None, None, "11", 9, 0)], "id int, title string, title_kana string, media string, media_text string, season_name string, season_name_text string, released_on string, syobocal_tid string, episodes_count int, watchers_count int")
    subs = ["窓辺", "灯台", "間口", "波音", "帆柱"]
    episodes = spark.createDataFrame([(10 + n, 1, float(n), f"第{n}話", 10 * n, s) for n, s in enumerate(subs, 1)], "id int, work_id int, number double, number_text string, sort_number int, title string")
    d = lambda k: 1_784_200_000_000 + k * 86_400_000  # noqa: E731  2026-07-16 and later
    rows = [(11, 1, 5, "窓辺", d(0), False), (11, 2, 5, "灯台", d(1), False)]  # marks of channel 5
    rows += [(11, 3, 5, "間口", d(2), False), (11, 1, 6, "窓辺", d(2), False)]  # two channels: the trusted one tells
    rows += [(11, 4, 5, "波音", d(3), True), (11, 4, 6, "波音", d(3), True)]  # doubtful, told alike
    rows += [(11, 5, 5, "帆柱", d(4), True)]  # doubtful, one channel
    rows += [(11, 5, 5, "帆柱", d(5), True), (11, 5, 6, "窓辺", d(5), True)]  # doubtful, subtitles differ
    programs = spark.createDataFrame([(i, *r[:4], r[4], False, r[5]) for i, r in enumerate(rows)], "pid int, tid int, count int, channel_id int, subtitle string, t long, deleted boolean, warn boolean")
    names = ["遠い海 #1「窓辺」 (20260716).ts", "遠い海 #2「灯台」 (20260717).ts", *[f"遠い海 (202607{k}).ts" for k in (18, 19, 20, 21)], "遠い海「ちがう」 (20260718).ts"]
    files = spark.createDataFrame([(i, f"/r/{n}") for i, n in enumerate(names)], "rec int, path string")
    out = {r["rec"]: r for r in link(files, works, episodes, programs).collect()}
    assert [(out[i]["strategy"], out[i]["episode_id"], out[i]["status"]) for i in (2, 3)] == [("trusted channel", 13, "linked"), ("corroborated schedule", 14, "linked")]
    assert [out[i]["status"] for i in (4, 5, 6)] == ["open"] * 3
    few = {r["rec"]: r for r in link(files.where("rec <> 1"), works, episodes, programs).collect()}
    assert few[2]["status"] == "open"  # one mark is not trusted


WORK = "id int, title string, title_kana string, media string, media_text string, season_name string, season_name_text string, released_on string, syobocal_tid string, episodes_count int, watchers_count int"
EPISODE = "id int, work_id int, number double, number_text string, sort_number int, title string"
PROGRAM = "pid int, tid int, count int, channel_id int, subtitle string, t long, t_end long, deleted boolean, warn boolean"
DAY0 = 1_784_200_000_000  # 2026-07-16


def catalogue(spark, works, episodes):
    w = spark.createDataFrame([(i, t, None, "tv", None, s, None, None, tid, n, 0) for i, t, s, tid, n in works], WORK)
    return w, spark.createDataFrame(episodes, EPISODE)


def test_tiers_finals_and_parts(spark):
    works = [
        (1, "遠い海", "2026-summer", None, 3), (2, "遠い海 第2クール", "2026-autumn", None, 2), (3, "遠い海 OVA", None, None, 1),
        (4, "長い空", None, None, 4), (5, "長い空 第2期", None, None, 3), (6, "夜の庭(2011)", "2011-spring", None, 2), (7, "夜の庭", "1999-spring", None, 1),
    ]
    episodes = [
        (11, 1, 1.0, "第1話", 10, "窓辺"), (12, 1, 2.0, "第2話", 20, "灯台"), (13, 1, 3.0, "第3話", 30, "波音"),
        (21, 2, 1.0, "第1話", 10, "帆"), (22, 2, 2.0, "第2話", 20, "錨"), (31, 3, 1.0, "第1話", 10, "浜辺の夜"),
        (41, 4, 1.0, "第1話", 10, "雲"), (42, 4, 2.0, "第2話", 20, "風"), (43, 4, None, "閑話", 30, "雨宿り"), (44, 4, None, "最終話", 40, "虹"),
        (51, 5, 13.0, "第13話", 10, "朝"), (52, 5, 14.0, "第14話", 20, "昼"), (53, 5, 15.0, "第15話", 30, "晩"),
        (61, 6, 1.0, "第1話", 10, "芽"), (62, 6, 2.0, "第2話", 20, "花の咲く夜"), (71, 7, 1.0, "第1話", 10, "種"),
    ]
    w, e = catalogue(spark, works, episodes)
    programs = spark.createDataFrame([], PROGRAM)
    names = {
        "遠い海[終].ts": (13, "final"),
        "長い空 最終回.ts": (44, "final"),
        "長い空 #3「雨宿り」.ts": (43, "place and subtitle"),
        "長い空 第2期 #2.ts": (52, "local number"),
        "長い空 第2期 #14「昼」.ts": (52, "label and subtitle"),
        "遠い海 #1「浜辺の夜」.ts": (11, "label"),
        "遠い海「浜辺の夜」.ts": (31, "special: subtitle"),
        "遠い海「錨」.ts": (22, "continuation: subtitle"),
        "夜の庭 #2「花の咲く夜」.ts": (62, "continuation: label and subtitle"),
        "夜の庭(2011) #1「芽」.ts": (61, "label and subtitle"),
        "長い空[終]「知らない題」.ts": (None, None),
    }
    files = spark.createDataFrame([(i, f"/r/{n}") for i, n in enumerate(names)], "rec int, path string")
    out = {r["path"][3:]: (r["episode_id"], r["strategy"]) for r in link(files, w, e, programs, LinkOptions(confidence=0)).collect()}
    assert out == names


def test_a_number_beyond_the_longest_list_counts_on_in_a_cour(spark):
    w, e = catalogue(spark, [(1, "遠い海 その一", None, None, 3), (2, "遠い海 その一 第2クール", None, None, 2)], [(10 + n, 1, float(n), None, n, None) for n in (1, 2, 3)] + [(20 + n, 2, float(n), None, n, None) for n in (1, 2)])
    files = spark.createDataFrame([(0, "/r/遠い海 #5.ts"), (1, "/r/遠い海 #6.ts"), (2, "/r/遠い海 #2.ts")], "rec int, path string")
    out = {r["rec"]: (r["episode_id"], r["strategy"]) for r in link(files, w, e, spark.createDataFrame([], PROGRAM), LinkOptions(confidence=0)).collect()}
    assert out == {0: (22, "cour offset"), 1: (None, None), 2: (None, None)}


def test_unresolved_works_veto_a_proof(spark):
    day = 86_400_000
    clean = [(0, 1, 5, None, 0), (0, 2, 5, None, 1), (0, 1, 5, None, 2)]  # (which work's id, count, channel, subtitle, day)
    cases = [  # schedule ids of two works, rows, episodes of three files
        (True, clean, {0: 11, 1: 12, 2: 11}),
        (False, clean, {0: None, 1: None, 2: None}),  # a work without a place in the schedule
        (True, [*clean, (1, 1, 6, None, 0), (1, 2, 6, None, 0)], {0: None}),  # counts that disagree
        (True, [*clean, (1, 1, 5, None, 1)], {1: 12}),  # another number than the name tells is no answer
        (True, [*clean, (1, 2, 5, None, 0)], {0: None}),  # two answers
        (True, [(0, 1, 5, "ちがう題名の話", 0)], {0: None}),  # a subtitle that contradicts
        (True, [(0, 2, 5, None, 2)], {2: None}),  # that of the name
    ]
    works, episodes, rows, files = [], [], [], []
    for c, (both, told, _) in enumerate(cases):
        tid = lambda k: 100 + 2 * c + k
        works += [(10 * c + k, f"遠い海{'いろはにほへと'[c]} {'甲乙'[k]}", None, str(tid(k)) if both or k == 0 else None, 2) for k in (0, 1)]
        episodes += [(1000 * c + 10 * k + 10 + n, 10 * c + k, float(n), f"第{n}話", n, f"題{k}の{n}番") for k in (0, 1) for n in (1, 2)]
        rows += [(1000 * c + i, tid(k), count, ch, sub, DAY0 + d * day, DAY0 + d * day + 1, False, False) for i, (k, count, ch, sub, d) in enumerate(told)]
        title = f"遠い海{'いろはにほへと'[c]}"
        files += [(10 * c, f"/r/{title} (20260716).ts"), (10 * c + 1, f"/r/{title} #2 (20260717).ts"), (10 * c + 2, f"/r/{title}「題0の1番 ほか」 (20260718).ts")]
    w, e = catalogue(spark, works, episodes)
    out = {r["rec"]: r["episode_id"] for r in link(spark.createDataFrame(files, "rec int, path string"), w, e, spark.createDataFrame(rows, PROGRAM)).collect()}
    for c, (_, _, want) in enumerate(cases):
        assert {k: out[10 * c + k] and out[10 * c + k] - 1000 * c for k in want} == want, c


def test_shared_cours_and_the_history(spark):
    works = [(1, "遠い海", None, "101", 2), (2, "遠い海 第2クール", None, None, 2), (3, "白い夜", None, "103", 2)]
    episodes = [(11, 1, 1.0, "第1話", 1, "窓辺"), (12, 1, 2.0, "第2話", 2, "灯台"), (23, 2, 3.0, "第3話", 3, "波音"), (24, 2, 4.0, "第4話", 4, "帆柱"), (31, 3, 1.0, "第1話", 1, "序章"), (32, 3, 2.0, "第2話", 2, "終章")]
    w, e = catalogue(spark, works, episodes)
    hour = 3_600_000
    rows = [(1, 101, 3, 5, "波音", DAY0, DAY0 + hour, False, False), (2, 101, 4, 5, "帆柱 後編", DAY0 + 24 * hour, DAY0 + 25 * hour, False, False), (3, 103, 1, 5, "序章", DAY0, DAY0 + hour, False, False), (4, 103, 2, 6, "終章", DAY0 + hour, DAY0 + 2 * hour, False, False)]
    programs = spark.createDataFrame(rows, PROGRAM)
    names = ["遠い海 (20260716).ts", "遠い海 (20260717).ts", "白い夜 (20260716).ts"]
    files = spark.createDataFrame([(i, f"/r/{n}") for i, n in enumerate(names)], "rec int, path string")
    history = spark.createDataFrame([(900, 66, DAY0 + hour, DAY0 + 2 * hour, "白い夜", [("白い夜 (20260716).ts",)])], "id long, channel_id long, start_at long, end_at long, name string, video_files array<struct<filename:string>>")
    channels = spark.createDataFrame([(5, 55), (6, 66)], "channel_id int, history_id long")
    out = {r["rec"]: (r["episode_id"], r["strategy"]) for r in link(files, w, e, programs, history=history, channels=channels).collect()}
    assert out == {0: (23, "shared cour"), 1: (None, None), 2: (32, "history")}
    moved = history.withColumn("end_at", F.col("end_at") + 1)
    assert {r["rec"]: r["episode_id"] for r in link(files, w, e, programs, history=moved, channels=channels).collect()}[2] is None


def test_broadcasts_in_the_files_agree_or_refuse(spark):
    w, e = catalogue(spark, [(1, "遠い海", None, None, 2)], [(11, 1, 1.0, "第1話", 1, "窓辺の夜"), (12, 1, 2.0, "第2話", 2, "灯台の朝")])
    files = spark.createDataFrame([(i, f"/r/{n}") for i, n in enumerate(["遠い海.ts", "遠い海 #2.ts", "遠い海 #1.ts", "遠い海 #1.mp4"])], "rec int, path string")
    told = spark.createDataFrame([(0, "[字]遠い海 第2話 灯台の朝"), (1, "遠い海 #1「窓辺の夜」"), (2, "遠い空 #1")], "rec int, name string").withColumn("recorded_date", F.lit(None).cast("date"))
    out = {r["rec"]: (r["status"], r["episode_id"]) for r in link(files, w, e, spark.createDataFrame([], PROGRAM), LinkOptions(confidence=70), told).collect()}
    assert out == {0: ("linked", 12), 1: ("refused", None), 2: ("refused", None), 3: ("linked", 11)}


def test_selections_are_laid_over_the_names(spark):
    w, e = catalogue(spark, [(1, "遠い海", None, None, 2)], [(11, 1, 1.0, "第1話", 1, "窓辺の夜"), (12, 1, 2.0, "第2話", 2, "灯台の朝")])
    files = spark.createDataFrame([(0, "/r/海の名場面 #7 (20260716).ts"), (1, "/r/海の名場面 #7 (20260717).ts"), (2, "/r/海の 名場面 (20260718).ts")], "rec int, path string")
    table = spark.createDataFrame([("海の名場面", 7, "2026-07-16", "遠い海", 2, "灯台の朝"), ("海の名場面", 0, "2026-07-18", "遠い海", 1, "窓辺の夜")], "title string, number int, day string, work_title string, episode_number int, subtitle string").withColumn("day", F.to_date("day"))
    out = {r["rec"]: r["episode_id"] for r in link(files, w, e, spark.createDataFrame([], PROGRAM), selections=table).collect()}
    assert out == {0: 12, 1: None, 2: 11}
