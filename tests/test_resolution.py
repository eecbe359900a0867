import itertools

from pyspark.sql import functions as F

from linkloom.functions import columns as C
from linkloom.operators import resolution as R
from linkloom.sources import latest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_unique_and_unanimous(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("b", 2, True), ("c", None, True), ("d", 1, False), (None, 5, True), ("e", 3, True), ("e", None, True)], "k string, v int, ok boolean")
    assert rows(R.unique_or_null(df, ["k"], "v")) == sorted([("a", None, 2), ("b", 2, 1), ("c", None, 1), ("d", 1, 1), (None, 5, 1), ("e", None, 2)], key=repr)
    assert ("a", 1, 1) in rows(R.unique_or_null(df, ["k"], "v", distinct=True))
    got = {r["k"]: r["value"] for r in R.unanimous(df, ["k"], "v", F.col("ok")).collect()}
    assert got == {"a": 1, "b": 2, "c": None, None: 5, "e": None}
    assert R.unanimous(df.limit(0), ["k"], "v", F.col("ok")).count() == 0


def test_corroborated_and_anchors(spark):
    df = spark.createDataFrame([("a", 1, 7, True, "x"), ("a", 1, 8, True, "y"), ("b", 1, 7, True, "x"), ("b", 2, 8, True, "y"), ("c", 1, 7, True, " "), ("c", 1, 8, True, "y"), ("d", 1, 7, False, "x"), ("d", 1, 8, True, "y")], "k string, v int, w int, doubt boolean, t string")
    assert rows(R.corroborated(df, ["k"], "v", "w", F.col("doubt"), "t")) == [("a", 1, 2)]
    marks = spark.createDataFrame([(1, "d1", 9, 1), (1, "d2", 9, 2), (1, "d1", 5, 3), (2, "d1", 9, 1), (2, "d2", 8, 2), (3, "d1", 9, 1)], "g int, m string, w int, o int")
    assert rows(R.anchors(marks, "g", ["m"], "w", ["o"])) == [(1, 2, 9)]


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 1), ("c", 1), ("d", None)], "g string, n int")
    assert rows(R.final_number(df, "g", "n")) == [("a", 3, 3), ("b", None, 2), ("c", None, 2)]
    assert rows(R.ordinals(df, "g", "n", [])) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    runs = spark.createDataFrame([("s2", 10, 25), ("s2", 20, 26), ("s1", 10, 1), ("s1", 20, 2), ("gap", 10, 5), ("gap", 20, 7)], "g string, o int, n int")
    assert rows(R.local_ordinals(runs, "g", "o", "n", [])) == [("s2", 25, 1), ("s2", 26, 2)]
    assert rows(R.disjoint(df, "g", "n"))[2] == ("c", 2, False)


def test_tiers_exhaustively(spark):
    """One answer of the first lone tier; ambiguity vetoes what follows in the tiers that say so."""
    tiers = [("x", True), ("y", False), ("z", True)]
    data, want = [], {}
    for n in itertools.product(range(3), repeat=3):
        key = "".join(map(str, n))
        data.append((key, "none", -1))
        want[key] = None
        for (t, veto), c in zip(tiers, n, strict=True):
            data += [(key, t, 10 * ord(t) + i) for i in range(c)]
        for (t, veto), c in zip(tiers, n, strict=True):
            if c == 1:
                want[key] = 10 * ord(t)
                break
            if c > 1 and veto:
                break
    df = spark.createDataFrame(data, "k string, t string, v int")
    assert {r["k"]: r["value"] for r in R.priority_tiers(df, ["k"], "t", "v", tiers).collect()} == want


def test_tiered_match_equals_brute_force(spark):
    words = ["月", "月と海", "海", "遠い海の夜", "夜", "", None, "月と海の夜", "abc"]
    lf = spark.createDataFrame([(i, w, w) for i, w in enumerate(words)], "id int, exact string, k string")
    rt = spark.createDataFrame([(100 + i, w and w + "!", w) for i, w in enumerate(["月と海", "海の夜", "夜", None, "", "b"])], "id int, exact string, k string")
    want = set()
    for i, w in enumerate(words):
        keys = [(100 + j, x) for j, x in enumerate(["月と海", "海の夜", "夜", None, "", "b"]) if x]
        if not w:
            continue
        same = [j for j, x in keys if x == w]
        want |= {(i, j, "key") for j in same} or {(i, j, "contains") for j, x in keys if x in w or w in x}
    assert set(rows(R.tiered_match(lf, rt))) == want


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "t", "p2"), (2, "t", "p1"), (3, "u", "p3")], "id int, target string, path string")
    assert rows(R.number_duplicates(df, "target", ["path"], "id")) == [(1, "t", 1), (2, "t", 0), (3, "u", 0)]
    best = spark.createDataFrame([("g", 5, 2, "b"), ("g", 5, 1, "a"), ("h", 0, 1, "c")], "g string, s int, o int, v string")
    assert rows(R.top_one(best, "g", F.col("s"), ["o"], ["v"])) == [("g", 5, "a")]
    assert rows(R.override(df, spark.createDataFrame([("t", "new")], "target string, path string"), ["target"], ["path"]))[0] == (1, "t", "new")
    two = spark.createDataFrame([(1, "x", 9), (1, "x", 10), (2, "y", None), (None, "z", 1)], "id int, v string, loaded_at int")
    assert rows(latest(two, "id")) == [(1, "x"), (2, "y")]
    value, clash = R.agree_or_conflict(F.col("a"), F.col("b"))
    said = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (None, None)], "a int, b int").select(value, clash)
    assert [tuple(r) for r in said.collect()] == [(1, False), (None, True), (2, False), (None, False)]


def test_columns(spark):
    labels = {"第7話": 7, "＃０７": 7, "ep.7": 7, "7": 7, "第0話": None, "7話まで": None, "": None, None: None, "9999999999": None}
    df = spark.createDataFrame([(k,) for k in labels], "t string").select("t", C.label_number(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == labels
    fractions = {"第08.50話": "8.5", "#1.0": None, "12.5": "12.5", "0.5話": "0.5", "x1.5": None}
    df = spark.createDataFrame([(k,) for k in fractions], "t string").select("t", C.fractional_label(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == fractions
    cases = [(7.0, "第9話", 10, 7), (None, "第9話", 10, 9), (None, "未定", 10, None), (None, " ", 10, 10), (None, None, 0, None), (8.5, None, 10, None), (None, "第8.5話", 85, None), (0.0, "第3話", 5, 3)]
    df = spark.createDataFrame(cases, "n double, t string, s int, want int").select("want", C.episode_number(F.col("n"), F.col("t"), F.col("s")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    paths = {"a/b:c?": "a／b：c？", "con.txt": "＿con.txt", " x. ": "x", "": ""}
    df = spark.createDataFrame([(k,) for k in paths], "t string").select("t", C.path_component(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == paths
    apart = spark.createDataFrame([("abcdefghij", "abcdefghiX", True), ("abcdefghij", "abcdefghijX", True), ("abcdefghij", "XbcdefghiX", False), ("abc", "abX", False)], "a string, b string, want boolean")
    assert all(r["want"] == r["got"] for r in apart.select("want", C.one_edit_apart(F.col("a"), F.col("b")).alias("got")).collect())
    assert [r[0] for r in spark.createDataFrame([("あ/い", "い／あ"), ("あ", "あ"), ("あ/い", "あ/う")], "a string, b string").select(C.same_parts(F.col("a"), F.col("b"))).collect()] == [True, False, False]
