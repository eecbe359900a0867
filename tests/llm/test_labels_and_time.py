import random

from pyspark.sql import functions as F

from linkloom.llm.label_trie import LabelTrie, best_entry, canonical_number, distance_limit, kanji_number, map_labels, roman_number, tokenise
from linkloom.llm.nearest_time import nearest_in_time

ENTRIES = [(n + 1, f"第{n}話") for n in range(30)] + [(90, "第8.5話"), (100, "最終話"), (101, "OVA"), (102, "前編"), (103, "後編"), (104, "特別編")]


def best(label):
    return best_entry(LabelTrie(ENTRIES), label)[1]


def test_numerals():
    assert [kanji_number(x) for x in ("二十三", "二三", "百二", "拾", "十百", "弐拾参")] == [23, 23, 102, 10, None, 23]
    assert [roman_number(x) for x in ("IV", "XXIX", "XL", "IIII", "VX", "")] == [4, 29, 40, None, None, None]
    assert [canonical_number(x) for x in ("08", "2.50", "0", "3.0")] == ["8", "2.5", "0", "3"]


def test_notations_reach_their_entry():
    for label in ("＃７", "ep.7", "EPISODE VII", "第七羽", "其の七", "Eipsode 7", "第⑦話", "7th ep", "(7)", "弟7話", "第7話話", "「第7話」", "第 7 話。", "dai 7 wa", "​第7話"):
        assert best(label) == 8, label
    assert best("#8.50") == 90
    assert best("最終輪") == 100 and best("O.V.A.") == 101 and best("ova") == 101 and best("スペシヤル") == 104


def test_labels_without_entry():
    for label in ("未定", "?", "第話", "第31話", "第1話〜第3話", "2・3話", "#4-#5", "N/A", "-", "なぞ", "第8.6話"):
        assert best(label) == 0, label


def test_a_number_is_never_edited():
    found, _ = best_entry(LabelTrie(ENTRIES), "第11話")
    assert found[0] == (12, 0) and all(d == 0 for k, d in found if k <= 30)


def test_ambiguous_is_unmatched():
    found, one = best_entry(LabelTrie(ENTRIES), "全編")
    assert one == 0 and {102, 103} <= {k for k, _ in found}


def brute(a, b, limit):
    fixed = lambda s: len(s) > 1
    far = 99
    d = [[far] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and not fixed(a[i - 1]):
                d[i][j] = min(d[i][j], d[i - 1][j] + 1)
            if j and not fixed(b[j - 1]):
                d[i][j] = min(d[i][j], d[i][j - 1] + 1)
            if i and j:
                c = 0 if a[i - 1] == b[j - 1] else far if fixed(a[i - 1]) or fixed(b[j - 1]) else 1
                d[i][j] = min(d[i][j], d[i - 1][j - 1] + c)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and not any(map(fixed, (a[i - 1], a[i - 2]))):
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1] if d[-1][-1] <= limit else None


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("abあい") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    trie = LabelTrie(enumerate(words))
    for _ in range(200):
        q = tokenise("".join(rng.choice("abあい3") for _ in range(rng.randint(1, 8))))
        for limit in (0, 1, 2):
            want = {k: d for k, w in enumerate(words) if (d := brute(tokenise(w), q, limit)) is not None}
            assert trie.search(q, limit) == want
    assert distance_limit(tokenise("SP")) == 0 and distance_limit(tokenise("最終話")) == 1


def test_map_labels_keeps_rows(spark):
    ref = spark.createDataFrame(ENTRIES, "label_id int, label string")
    rows = [(1, "第3話", "x"), (1, "第3話", "x"), (2, None, None), (3, "  ", "y"), (4, "", ""), (5, "ep 3", "z"), (6, "あ" * 50_000, "long")]
    df = spark.createDataFrame(rows, "id int, label string, label_id string")
    out = map_labels(df, "label", ref).collect()
    assert len(out) == 7
    by = {r["id"]: r for r in out}
    assert by[1]["label_id"] == 4 and by[1]["label_exact"] and by[5]["label_id"] == 4 and not by[5]["label_exact"]
    assert by[2]["label_id"] is None and by[3]["label_id"] is None and by[4]["label_candidates"] is None and by[6]["label_id"] == 0
    assert map_labels(df.limit(0), "label", ref).count() == 0
    assert [r["label_id"] for r in map_labels(df, "label", ref.limit(0)).where("id = 5").collect()] == [0]


def nearest_brute(left, right, tol):
    out = []
    for k, i, t in left:
        if None in (k, i, t):
            continue
        c = sorted((abs(t - u), u > t, j) for h, j, u in right if None not in (h, j, u) and h == k and abs(t - u) <= tol)
        if c:
            first = [x for x in c if x[:2] == c[0][:2]]
            out.append((i, min(x[2] for x in first), c[0][0]))
    return sorted(out)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(["a", "a", "a", "a", "b", None])
    left = [(key(), i, rng.choice([None, rng.randint(0, 40_000)])) for i in range(600)] + [("a", 7, 100), ("a", 7, 100)]
    right = [(key(), 1000 + i, rng.randint(-2_000, 42_000)) for i in range(150)] + [("a", 5000, 100), ("a", 4999, 100), ("b", None, 3)]
    schema = "key string, id long, time_ms long"
    lf = spark.createDataFrame(left, schema).withColumn("g", F.lit(1)).withColumn("side", F.lit("x"))
    rt = spark.createDataFrame(right, schema).withColumn("s", F.lit(2))
    for kw in ({}, {"bucket_ms": 1, "max_group": 3, "chunk_rows": 5}, {"bucket_ms": 5_000, "max_group": 7, "chunk_rows": 40}):
        got = sorted(tuple(r) for r in nearest_in_time(lf, rt, 300, **kw).collect())
        assert got == nearest_brute(left, right, 300), kw
    assert nearest_in_time(lf.limit(0), rt, 300).count() == 0 and nearest_in_time(lf, rt.limit(0), 300).count() == 0
