"""Names of every shape, each with what it tells: title, number, label, subtitle, final; or the kind of refusal."""

import datetime

import pytest

from linkloom.functions.names import Reader, content_label, description_header, fold, headers, parse_name

N = None
TOLD = {
    # marks in words and signs
    "星の庭 ＥＰ．７「窓」 (20260801).mp4": ("星の庭", 7, N, "窓", False),
    "星の庭 ep  7「窓」.mkv": ("星の庭", 7, N, "窓", False),
    "星の庭 ｔｒａｃｋ－３ (2020_1_22).mp4": ("星の庭", 3, N, N, False),
    "星 EPISODE 12 (2022_09_25).mp4": ("星", 12, N, N, False),
    "星 Ver1.1a Chapter.10 (20230723).mp4": ("星 Ver1.1a", 10, N, N, False),
    "星 karte12「僕」.mp4": ("星", 12, N, "僕", False),
    "星 MISSION：13「札」.mp4": ("星", 13, N, "札", False),
    "星【ＭＩＳＳＩＯＮ：１６】夜.mp4": ("星", 16, N, N, False),
    "星 Lv．1「名」.mp4": ("星", 1, N, "名", False),
    "灯~! ろ~る4「海~!」.mp4": ("灯~!", 4, N, "海~!", False),
    "星 STAGE01「青」.mp4": ("星", 1, N, "青", False),
    "星 れぽーと05「潮」.mp4": ("星", 5, N, "潮", False),
    "星。 home．02「彼」.mp4": ("星。", 2, N, "彼", False),
    "星 HOME 2「多」.mp4": ("星 HOME 2", N, N, "多", False),
    "星 ♯10 (20250608).mp4": ("星", 10, N, N, False),
    "星の庭 -そら- 【すてっぷ①】 (2022_10_06).mp4": ("星の庭 -そら-", 1, N, N, False),
    # counters
    "星 第１２回 (2021_04_01).mp4": ("星", 12, N, N, False),
    "星 episode of side-A 第６局「奪」.mp4": ("星 episode of side-A", 6, N, "奪", False),
    "星 第10Ｒ「何」 (2021_09_06).mp4": ("星", 10, N, "何", False),
    "星!? 10時限目.mp4": ("星!?", 10, N, N, False),
    "星 12軒目.mp4": ("星", 12, N, N, False),
    "星 日記 1日記「魔」.mp4": ("星 日記", 1, N, "魔", False),
    "星 １ふさ目「来」.mp4": ("星", 1, N, "来", False),
    "星！（１０）「独」[字].mp4": ("星！", 10, N, "独", False),
    "星 十三の巻「決」.mp4": ("星", 13, N, "決", False),
    "星 第拾壹話「誘」.mp4": ("星", 11, N, "誘", False),
    "長い星 第千百一話「千」.mp4": ("長い星", 1101, N, "千", False),
    "星の庭 のん「十一話 酔い」 (2021_03_23).mp4": ("星の庭 のん", 11, N, "酔い", False),
    "星 第7「窓」 (20260801).mp4": ("星 第7「窓」", N, N, N, False),
    "星 9話までを振り返り (20250101).mp4": ("星 9話までを振り返り", N, N, N, False),
    # fractions
    "星 #05.5「総」.mp4": ("星", N, "5.5", "総", False),
    "星 第6．5話「総」.mp4": ("星", N, "6.5", "総", False),
    "星 #10.50.mp4": ("星", N, "10.5", N, False),
    # tags, boxes and wrappers
    "【星の子】 第2期 ep.1「窓」 (20260801).mp4": ("【星の子】 第2期", 1, N, "窓", False),
    "【星の子】[終]#35 (20260326).mp4": ("【星の子】", 35, N, N, False),
    "　【字幕】星 ep.7「窓」.mp4": ("星", 7, N, "窓", False),
    "星【日本語】ep.7「窓」.mp4": ("星【日本語】", 7, N, "窓", False),
    "星 【ＡＮｉＭＡＺｉＮＧ！！！】 ＃１「四人」.mp4": ("星", 1, N, "四人", False),
    "[字]アニメA「きみ」と言った人 #4 (20260727).mp4": ("「きみ」と言った人", 4, N, N, False),
    "[新]アニメA・星の庭 ＃１ ※＃２は25時から.mp4": ("星の庭", 1, N, N, False),
    "TVアニメ『市』 #10 (20250908).mp4": ("市", 10, N, N, False),
    "TVアニメ「星」10th COUNTDOWN！.mp4": ("「星」10th COUNTDOWN！", N, N, N, False),
    "『星』第一夜［絆］【劇場版『列車』】.mp4": ("星", 1, N, "絆", False),
    "「星の庭」.mp4": ("星の庭", N, N, N, False),
    # guides: numbers alone, tails without quotation
    "アニメ 星の庭 09 手のしるし (20260903).mp4": ("星の庭", 9, N, "手のしるし", False),
    "アニメ 星 09 第10話「正」.mp4": ("星 09", 10, N, "正", False),
    "アニメ 星 9 手.mp4": ("星 9 手", N, N, N, False),
    "星 09 手.mp4": ("星 09 手", N, N, N, False),
    "アニメ 星 ~双~2 21 (20260830).mp4": ("星 ~双~2", 21, N, N, False),
    "アニメ 星[終] 第148話 夜×朝.mp4": ("星", 148, N, "夜×朝", False),
    # series with words of their own
    "メダリスト 第2期 score06「初」.mp4": ("メダリスト 第2期", 6, N, "初", False),
    "夜桜さんちの大作戦 作戦40 花嫁.mp4": ("夜桜さんちの大作戦", 40, N, "花嫁", False),
    # subtitles and finals
    "星 #01 「冒険 Episode 00」.mp4": ("星", 1, N, "冒険 Episode 00", False),
    "空 #05 「灰 #6E60A8」.mp4": ("空", 5, N, "灰 #6E60A8", False),
    "星 #17 「「甲」がきた！」.mp4": ("星", 17, N, "「甲」がきた！", False),
    "星\\庭「コミ４４ 冬」[解][字].mp4": ("星\\庭", N, N, "コミ４４ 冬", False),
    "星の庭 OVA#「特別話」.mp4": ("星の庭 OVA", N, N, "特別話", False),
    "星の庭 特番#「」.mp4": ("星の庭 特番#「」", N, N, N, False),
    "星、花 # 「星、話 おかわり」#10」.mp4": ("星、花", 10, N, N, False),
    "星[終]最終話「夏」 (2021_09_26).mp4": ("星", N, N, "夏", True),
    "星の庭 最終回直前スペシャル#「」.mp4": ("星の庭 最終回直前スペシャル#「」", N, N, N, False),
    "ワールド イズ ダンシング 留〆[終].mp4": ("ワールド イズ ダンシング", N, N, N, True),
    "星 セレクション放送 (20260101).mp4": ("星", N, N, N, False),
    "星 セレクション放送.mp4": ("星 セレクション放送", N, N, N, False),
}
REFUSED = {
    "empty": [".mp4", ".", "......mp4", "[字] (20220705).m2ts", ""],
    "date": ["海 (20261399).mp4", "海 #1 (2026_13_1).mp4"],
    "unsupported": ["海 第7話エンディング映像.mp4", "海 全12話総集編.mp4"],
    "ambiguous": [
        "海 #0 (20260801).mp4", "海 ep.99999999999999999999.mp4", "海 #01,02「一」.mp4", "海 第01,02,03話「一」.mp4", "海 #01「一」 ／ #16「十」.mp4",
        "海 #1「一」#2「二」.mp4", "海 第7話「前」，第8話「後」.mp4", "海 10話／11話.mp4", "海 1～4話.mp4", "海 1ふさ目／2ふさ目.mp4", "海 home.01／2ふさ目.mp4",
        "海（1）～（3）.mp4", "海 #4-#6.mp4", "海 #1.5 #2.mp4", "海 #1.0.mp4", "海 #1.5x.mp4", "メダリスト score06、07.mp4", "海 第1話〜第3話.mp4",
    ],
}


@pytest.mark.parametrize("name", TOLD)
def test_told(name):
    p = parse_name(name)
    assert (p["work_title"], p["episode_number"], p["episode_label"], p["subtitle"], p["final_episode"]) == TOLD[name] and p["error"] is None


@pytest.mark.parametrize("kind,name", [(k, n) for k, names in REFUSED.items() for n in names])
def test_refused(kind, name):
    assert parse_name(name)["error_kind"] == kind


def test_days():
    for end in ("(20260801)", "（２０２６０８０１）", "(2026_8_1)", "(20260801)(2)", "(2026_08_01)-3"):
        p = parse_name(f"海 第7話「窓」 {end}.mp4")
        assert p["recorded_date"] == datetime.date(2026, 8, 1) and p["subtitle"] == "窓"
    assert parse_name("20260801 海 ep.7.mp4")["recorded_date"] is None


def test_broadcasts_keep_what_stands_behind_the_number():
    assert parse_name("海 第3話 遠い窓.ts")["subtitle"] is None
    assert parse_name("海 第3話 遠い窓[字].ts", broadcast=True)["subtitle"] == "遠い窓"


def test_places_stay():
    text = "ＡＢ①ｶﾞ㌢第３話［終］"
    assert len(fold(text)) == len(text) and [t.text for t in Reader("第３話").tokens] == ["第", "3", "話"]


def test_headers_of_descriptions():
    told = lambda d: (lambda p: p and (p["work_title"], p["episode_number"], p["episode_label"], p["subtitle"], p["error_kind"]))(description_header("海", d))
    assert told("第3話「窓辺」\n前回の第2話では…") == ("海", 3, None, "窓辺", None)
    assert told("  #12 遠い灯台") == ("海", 12, None, "遠い灯台", None) and told("第十二話　波") == ("海", 12, None, "波", None)
    assert told("～夏の章～ 第2話 帆") == ("海 ～夏の章～", 2, None, "帆", None) and told("第2.5話「間」") == ("海", None, "2.5", "間", None)
    assert told("前回、第2話で…") is None and told("") is None and told(None) is None and told("～夏の章～ 波") is None
    assert told("#1～#3 一挙")[4] == "ambiguous" and told("第0話")[4] == "ambiguous"


def test_labels_of_content_fields():
    assert content_label({"番組内容": "第3.5話"}, None) == ("3.5", False)
    assert content_label({"出演者": "第3.5話", "◇今回の番組内容": " #3.50 "}, "◇番組内容\n第3.5話\n◆出演\n甲") == ("3.5", False)
    assert content_label({"番組内容": "第3.5話"}, "◇番組内容\n第4.5話") == (None, True)
    assert content_label({"番組内容": "第3.5話の続き"}, None) == (None, True) and content_label({"番組内容": "第3話"}, "第3.5話") == (None, False) and content_label(None, None) == (None, False)


def test_header_columns(spark):
    rows = [("海", "第3話「窓辺」"), ("海", None), (None, "第3話"), ("海", "波")]
    out = spark.createDataFrame(rows, "t string, d string").select(headers()("t", "d").alias("h")).collect()
    assert [r["h"]["episode_number"] for r in out] == [3, None, None, None]
