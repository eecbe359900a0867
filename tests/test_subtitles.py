from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.functions import subtitles as S


def test_identity_and_dates():
    assert S.same_identity("窓辺の夜！", "窓辺の夜") and S.same_identity("海・前編", "海（前編）") and not S.same_identity("海 前編", "海 後編")
    assert not S.same_identity("", "") and not S.same_identity("!?", "!")
    assert S.date_proven("窓辺／灯台／波音", "灯台／波音") and not S.date_proven("窓辺／灯台", "波音")
    assert S.date_proven("窓辺／灯台", "灯台／窓辺") and not S.date_proven("窓辺／灯台", "灯台／灯台")
    assert S.date_proven("窓辺の夜／灯台の朝／波音", "窓辺の夜 ほか") and S.date_proven("窓辺の夜／灯台の朝／波音", "灯台の朝　他２本")
    assert not S.date_proven("窓辺の夜／灯台の朝", "灯台の朝／窓辺の夜 ほか") and not S.others_named("ほか", "窓辺")
    assert not S.composite_part("窓／灯", "窓") and not S.composite_part("窓辺の夜", "窓辺の夜")


def test_agreement_of_selected_episodes():
    for a, b in (
        ("窓辺の夜＆灯台の朝", "窓辺の夜／灯台の朝"),
        ("a:窓辺の夜／b:灯台の朝", "窓辺の夜"),
        ("騎士の夜 i／騎士の夜 ii", "騎士の夜"),
        ("とても長い窓辺の夜", "とても長い窓辺の夜（それでも灯台は光っている）"),
        ("窓辺の夜", "窓辺の夜 -ひとりきりの灯台-"),
        ("窓辺の夜", "窓辺の夜〜灯台の光〜"),
        ("窓辺の夜", "窓辺の夜(^_^)"),
        ("第四夜（窓辺の夜）", "窓辺の夜"),
        ("かんばれムース", "がんばれムース"),
        ("どこまでも続く長い窓辺の夜", "どこまでも続く長い窓辺夜"),
        ("Café の夜", "Cafe の夜"),
        ("晴天の霹靂", "青天の霹靂"),
        ("水着で１日", "水着の1日"),
    ):
        assert S.agrees(a, b) and S.agrees(b, a), (a, b)
    for a, b in (("窓辺 前編", "窓辺 後編"), ("窓", "窓辺の夜"), ("とても長い窓辺の夜", "とても長い窓辺の夜（後編）"), ("窓辺の夜", "窓辺の夜 -灯-"), ("短い窓", "短い窓辺"), ("", ""), ("夜", "")):
        assert not S.agrees(a, b), (a, b)
    assert S.trailing_label("長い長い旅の果てに見た景色と人々の暮らし 灯台の朝に", "灯台の朝に") and not S.trailing_label("旅 灯台の朝に", "灯台の朝に")
    assert S.partly("遠い海の夜", "海の夜") and not S.partly("夜x", "夜")


def test_single_answers():
    assert S.is_generic_final("最終回！") and S.is_generic_final("最終話SP") and not S.is_generic_final("最終回の夜")
    assert S.is_zero_label("life.0 はじまり") and S.is_zero_label("LIFE 00") and not S.is_zero_label("life.10")
    assert S.unavailable(" ") and S.unavailable(" と ") and not S.unavailable("と") and not S.unavailable("窓")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="あい窓夜/／&、()（）-~ ABCi他ほか・…１", max_size=24), st.text(alphabet="あい窓夜/／&、()（）-~ ABCi他ほか・…１", max_size=24))
def test_rules_hold_together(a, b):
    assert S.agrees(a, b) == S.agrees(b, a)
    if S.scoring_key(a):
        assert S.agrees(a, a)
    if S.same_identity(a, b):
        assert S.date_proven(a, b)


def test_relation(spark):
    rows = [("窓辺の夜！", "窓辺の夜"), ("窓辺／灯台／波", "窓辺／灯台"), ("窓辺の夜", "窓辺の夜(^_^)"), ("遠い海の夜", "海の夜"), ("海", "山"), (None, "x"), ("x", " "), ("x", None)]
    out = spark.createDataFrame(rows, "a string, b string").select(S.relation()("a", "b").alias("r")).collect()
    assert [r["r"] for r in out] == [3, 2, 1, 0, -1, None, None, None]
