import random
import re
import unicodedata

from linkloom.llm.leaks import ItemIndex, extend, find_leaks, level, level_with_map, remove_leaks
from linkloom.llm.lookalike import character_map, lookalike_classes, lookalike_pairs, skeleton, unify_texts
from linkloom.llm.mojibake import examine, find_garbled, letters_restored, reread
from linkloom.llm.stuffing import dissect, stuffed_pages

SOUND = ["テレビアニメ　孤独な転校生 Trémolo 第2期#13 「あべこべ停留所とギターの夜!」[再]", "Ωμέγα研究所 #18", "ドラマ「Восток」第5回", "ÀLA CARTE Ñandú 13", "ﾃﾚﾋﾞｱﾆﾒ　遠い剣舞 Nimbus", "作画は極光の質感に力が入っていて、丁寧に描かれている。", "", " ", "C&A 100% ½", "[解][字]黒いピアノ Ｔｒéｍｏｌｏ▼＃１９"]


def test_sound_texts_stay():
    for text in SOUND:
        assert examine(text)[:2] == (False, text), text


def test_garbled_texts_are_restored():
    text = "月影のパレット 第8話「静かな庭師の手紙」を再放送します。"
    for wrote, read in (("utf-8", "latin-1"), ("utf-8", "cp1251"), ("cp932", "latin-1"), ("euc_jp", "latin-1"), ("utf-8", "koi8-r")):
        try:
            bad = text.encode(wrote).decode(read)
        except UnicodeDecodeError:
            bad = "".join(bytes([b]).decode(read, "replace") if bytes([b]).decode(read, "replace") != "�" else chr(b) for b in text.encode(wrote))
        garbled, fixed, repairs, whole, ended = examine(bad)
        assert garbled and fixed == text and whole and ended, (wrote, read, fixed)
    twice = text.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert examine(twice)[1] == text
    jis = text.encode("iso2022_jp").decode("ascii").replace("\x1b", "")
    assert examine(jis)[:2] == (True, text)
    part = "作画はガーデンの質感に、" + "静かな光まで".encode("utf-8").decode("latin-1")
    assert examine(part)[1] == "作画はガーデンの質感に、静かな光まで"
    assert examine("�e���r�A�j���@第3話")[0] and examine("????????")[0]
    assert reread("abc", "latin-1", "utf-8") is None
    for sound in ("Really???? What", "え????本当に？", "100%??", "?", "なぜ? どうして?"):
        assert not examine(sound)[0], sound


def test_single_garbled_letters_are_restored():
    for text in ("Café", "São", "Façade", "Naïve", "Trémolo", "Pêche", "Étoile", "黒いピアノ Trémolo 第3話", "Yūki 12", "20°C"):
        for read in ("latin-1", "cp1252"):
            try:
                bad = text.encode("utf-8").decode(read) if text.isascii() or not re.search("[぀-鿿]", text) else "".join(c.encode("utf-8").decode(read) if "À" <= c < "ɐ" else c for c in text)
            except UnicodeDecodeError:
                continue
            assert examine(bad)[:2] == (True, text), (bad, examine(bad))
    for text in ("«CAFÉ»", "“RENÉ”", "RENÉ™", "»Ö«", "Ñandú…", "Über – Ä", "LÀ… ÉTÉ—", "Ålesund", "20°C", "±5 §3"):
        assert letters_restored(text) == text, text


def test_find_garbled_rows(spark):
    rows = [(1, "name", None, 5), (2, "name", "", 5), (3, "name", "Ã©tÃ©", 5), (3, "name", "Ã©tÃ©", 5), (4, "name", "あ" * 30_000, 5)]
    df = spark.createDataFrame(rows, "id int, field string, text string, garbled int")
    out = sorted((r["id"], r["garbled"], (r["restored"] or "")[:5]) for r in find_garbled(df).collect())
    assert out == [(1, None, ""), (2, False, ""), (3, True, "été"), (3, True, "été"), (4, False, "あ" * 5)]
    assert find_garbled(df.limit(0)).count() == 0


def test_looks():
    assert skeleton("Ｃａｆé") == "Café" and skeleton("ｶﾞ") == "ガ" and skeleton("か゛") == "が"
    assert skeleton("Сafé") == skeleton("Café") and skeleton("ケ卜ル") == "ケトル" and skeleton("べンチ") == "ベンチ"
    assert skeleton("a​b c　d") == "ab c d"
    for a, b in (("か", "が"), ("ッ", "ツ"), ("Cafe", "Café"), ("a b", "ab"), ("ABC", "abc"), ("夜!", "夜?"), ("①", "1")):
        assert skeleton(a) != skeleton(b), (a, b)


def test_unified_texts_equal_the_definition(spark):
    rng = random.Random(1)
    pool = [*"abc é", "́", "̧", "̣", "e", "ｶ", "ﾞ", "ﾟ", "ハ", "゛", "‍", "ー", "一", "А", "α", "각", "ᄀ", "ᅡ", "ᆨ", "ﬁ", "𝐀", "🙂"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["", " ", "​", "あ" * 3_000 + "ｶﾞ"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = {r["text"]: r["form"] for r in unify_texts(df).collect()}
    assert set(got) == set(texts)
    nfc = lambda s: unicodedata.normalize("NFC", "".join(character_map().get(c, c) for c in s))
    for t in texts:
        if not re.search("[\u1100-\u11ff각].*[\u0300-\u036f\u3099\u309aﾞﾟ゛]", t):
            assert got[t] == nfc(t) == skeleton(t), [hex(ord(c)) for c in t]
    assert skeleton("각") == skeleton("각") == "각"


def test_pairs_and_classes(spark):
    rows = [("w", 1, "Café", 0), ("w", 2, "Café", 0), ("w", 2, "Café", 0), ("w", 3, "Café", 0), ("e", 4, "Café", 0), ("w", 5, None, 0), ("w", 6, " ", 0), ("w", 7, "　", 0), ("w", None, "Ｃafé", 0)]
    df = spark.createDataFrame(rows, "tbl string, id long, text string, form int")
    assert sorted(tuple(r) for r in lookalike_pairs(df).collect()) == [("w", 1, 2), ("w", 2, 3)]
    classes = lookalike_classes(df).collect()
    assert len(classes) == 8 and len({r["class_id"] for r in classes if r["tbl"] == "w" and r["form"] == "Café"}) == 1
    assert lookalike_pairs(df.limit(0)).count() == 0


ITEM = "夜更けの峠ではスープの値が37倍になり、マユキは忘れられた手つきで帳簿をめくる。約20年続いた峠の冬が終わる晩、隣町のレコードを連れた旅人が戸を叩く。"


def test_leveling():
    assert level("Ａ<b>b</b> &amp; c-\n「ｶﾞ」") == "abcガ"
    text = "x <i>Ａ</i>　b&#12354;"
    flat, starts, ends = level_with_map(text)
    assert flat == "xabあ" and [text[i:j] for i, j in zip(starts, ends)] == ["x", "Ａ", "b", "&#12354;"]
    assert extend("abcdXefgh", "abcdefgh", 0, 0, 1, 4) == (9, 8)


def test_leaks(spark):
    half = ITEM[: int(len(ITEM) * 0.55)]
    noisy = "".join(c if i % 17 else "★" + c for i, c in enumerate(ITEM)).replace("手つき", "手っき")
    docs = [(1, "前置き。" + half + "後書き。"), (2, ITEM[:20]), (3, noisy), (4, None), (5, ""), (6, "> " + "\n> ".join(ITEM[i : i + 9] for i in range(0, len(ITEM), 9))), (6, "x"), (7, "関係のない文章です。" * 200)]
    df = spark.createDataFrame([(*d, "v") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(11, ITEM), (12, ITEM + "別の続き" * 60), (13, None), (14, "短い")], "item_id long, text string")
    found = find_leaks(df, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 11), (3, 11), (6, 11)}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(df, items, block_chars=10).collect()} == {(1, 11), (3, 11), (6, 11)}
    kept = {r["doc_id"]: r for r in remove_leaks(df.select("doc_id", "text"), found).where("doc_id <> 6").collect()}
    assert set(kept) == {2, 4, 5, 7} and kept[4]["text"] is None and kept[7]["leak_items"] is None
    long = remove_leaks(spark.createDataFrame([(9, "始まり" * 100 + ITEM + "終わり" * 100)], "doc_id long, text string"), find_leaks(spark.createDataFrame([(9, "始まり" * 100 + ITEM + "終わり" * 100)], "doc_id long, text string"), items)).collect()[0]
    assert "帳簿" not in long["text"] and long["text"].startswith("始まり") and long["text"].endswith("終わり") and long["leak_items"] == [11]
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0


def test_levelling_with_places_is_the_same():
    rng = random.Random(7)
    pool = [*"ab ,。あかﾊ", "ﾞ", "ﾟ", "゙", "́", "̧", "<b>", "</b>", "[url=x]", "](http://a)", "&amp;", "&#12354;", "&#x41", ";", "&", "각", "ᄀ", "ᅡ", "ᆨ", "ﬁ", "①", "İ", "ß", "ς", "়", "ো"]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        flat, starts, ends = level_with_map(text)
        assert flat == level(text), ascii(text)
        assert all(0 <= i < j <= len(text) for i, j in zip(starts, ends)) and starts == sorted(starts)


def test_every_copy_of_an_item_is_cut(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "二年前の朝食")], "item_id long, text string")
    filler = "&#12354;&#12356;&#12358;" * 30
    docs = [(1, filler + "。前" + ITEM + "まんなか" * 40 + ITEM + "終わり" * 60), (2, "昨日も二年前の朝食を思い出した。" * 2 + "別の話がここから続いていく、とても長い文章になる。" * 3), (3, "二年前の朝")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, leak_chars int")
    found = find_leaks(df, items)
    assert {(r["doc_id"], r["item_id"], len(r["spans"])) for r in found.collect()} == {(1, 1, 2), (2, 2, 2)}
    kept = {r["doc_id"]: r for r in remove_leaks(df, found).collect()}
    assert kept[1]["text"].replace("\n", "").replace("。", "") == filler + "前" + "まんなか" * 40 + "終わり" * 60
    assert "朝食" not in kept[2]["text"] and kept[3]["text"] == "二年前の朝"


def test_passages_of_many_items_are_found(spark):
    items = [(i, ITEM + f"問{i}、" + chr(0x4E00 + i) * 9) for i in range(6)] + [(90, ITEM + "問0、" + chr(0x4E00) * 9)]
    df = spark.createDataFrame([(1, "前置き。" + ITEM + "後書き。"), (2, ITEM[:20])], "doc_id long, text string")
    wanted = {(1, k) for k, _ in items}
    for chars in (4_000_000, 200, 10):
        found = find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), block_chars=chars).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == wanted and len({(r["run_chars"], r["start"], r["end"]) for r in found}) == 1


def test_changes_close_together_part_no_run_beside_a_stock_phrase():
    item = level(ITEM)
    stock = "次回もお楽しみに今週は"
    text = item[:30] + stock + item[30:]
    doc = item[:30] + stock[:2] + "XYZ" + stock[5:] + item[30:]
    assert max(n for k, n, *_ in ItemIndex(((1, text), (2, stock + item[:25])), 10).leaks(doc, 4) if k == 1) >= 0.9 * len(text)


PROSE = "編集は狐火の切り返しが速く、ユラキの表情を39回も重ねている。限定特典の冊子にエマオのクジラを描いた空飛ぶ地図が付き、通販では34分で品切れになった。"


def test_stuffed(spark):
    words = "予約 感想 動画 送料無料 最新 ランキング 通販 特典".split()
    stuffed = " ".join(words[i % 8] for i in range(0, 120, 3))
    links = "\n".join(f"https://a{i}.example/{i}" for i in range(20))
    comments = "\n".join(f"{PROSE} https://a{i}.example/{i}" for i in range(4))
    episodes = "\n".join(f"・第{i}話 丸いパレットとミルクを探して (3/{i} 12:00)" for i in range(1, 20))
    spaced = " ".join("予約感想動画予約感想動画送料無料予約感想送料無料予約動画")
    docs = [(1, "h1", stuffed), (2, "h2", PROSE * 3 + "\n" + stuffed[:60]), (3, "h3", links), (4, "h1", comments), (5, "h2", episodes), (6, None, None), (7, "h", ""), (8, None, " / ".join(words * 5)), (9, "h", PROSE + "\n" + "#" + " #".join(words)), (10, "h", spaced), (3, "h3", links)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, site string, text string, chars int")
    out = stuffed_pages(df).where("stuffed")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 3, 8, 10]
    assert stuffed_pages(df.limit(0)).count() == 0
    total, listed, *_ = dissect("Once Koton learns \nwhat the nameless \ncottage is, Sayari\n stays behind in C\nobalt Hill with th\ne ferry.")
    assert total > 60 and listed == 0


def test_other_hosts_decide(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("アイウエオカキクケコサシスセソタチツテト") for _ in range(rng.randint(3, 6)))
    phrases = sorted({word() for _ in range(60)})
    page = "・".join(phrases)
    pairs = [f"{a} {b}" for a, b in zip(phrases[::2], phrases[1::2])]
    spaced = " ".join(phrases)  # one run of words: only its pairs in order are phrases

    def judge(others):
        docs = [(1, "h1", page), (2, "h1", spaced)] + [(10 + i, h, t) for i, (h, t) in enumerate(others)]
        out = stuffed_pages(spark.createDataFrame(docs, "doc_id long, site string, text string"))
        return {r["doc_id"] for r in out.where("stuffed").collect()} & {1, 2}

    prose = "。".join(f"{PROSE}、{p}" for p in phrases)
    assert judge([]) == set()  # a list of its own words
    assert judge([("h2", prose), ("h2", prose), ("h1", page)]) == set()  # two hosts
    assert judge([("h2", prose), ("h3", prose)]) == {1}  # three, in sentences too
    assert judge([(h, "、".join(f"{PROSE}、{p}" for p in pairs[1:])) for h in ("h2", "h3")]) == set()  # half of the pairs
    assert judge([("h2", spaced), ("h3", PROSE + spaced)]) == {2}


def test_shingles_add_up():
    from linkloom.llm.stuffing import shingles

    assert list(shingles("aa bb  cc, dd / ee ff", 2)) == [("aa bb", 2), ("bb cc", 4), ("dd", 2), ("ee ff", 4)]
    assert list(shingles(" ,, ", 2)) == [] and sum(n for _, n in shingles("x" * 9_999 + " y・z", 3)) == 10_001
