import random

import pytest
from pyspark.sql import functions as F

from linkloom.llm.entity import belief_propagation, edit_distance, heard_titles, match_recordings, take_apart
from linkloom.llm import mixing
from linkloom.llm.mixing import mix_period, mix_report, mix_schedule, period_shares, pfair_period


def test_pfair_keeps_within_one_block():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.03}, {f"s{i}": 1 / 7 for i in range(7)}):
        shares = period_shares(weights, 1000)
        assert sum(shares.values()) == 1000
        plan = sorted(pfair_period(shares, 1000), key=lambda x: x[4])
        assert [x[4] for x in plan] == list(range(1000)) and all(r <= slot < d for _, _, r, d, slot in plan)
        sent = dict.fromkeys(shares, 0)
        for t, (s, *_) in enumerate(plan, 1):
            sent[s] += 1
            assert all(abs(sent[k] - n * t / 1000) < 1 for k, n in shares.items())


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(0, 40)) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 5 + [None] * 20 + ["untargeted"] * 40)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("gone", 0.1, 3), (None, 0.2, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    total = sum(r[2] for r in rows)
    report = {r["source"]: r for r in mix_report(sized(spark, rows), targets, block_tokens=50, period=100).collect()}
    assert set(report) == {"a", "b", "c", "gone"}
    for s, (w, cap) in {"a": (0.5, 1), "b": (0.3, 4), "c": (0.1, 2), "gone": (0.1, 3)}.items():
        have = sum(r[2] for r in rows if r[1] == s)
        assert report[s]["delivered_tokens"] == min(int(w * total), cap * have) and report[s]["filled"] == (cap * have >= int(w * total))
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    for per in (200_000, 7):
        out = mix_schedule(sized(spark, rows), targets, block_tokens=50, period=100, rows_per_bucket=per).collect()
        tokens = {r[0]: r[2] for r in rows}
        for s in ("a", "b", "c"):
            mine = [r for r in out if r["source"] == s]
            assert sum(r["tokens"] for r in mine) == report[s]["delivered_tokens"] and report[s]["deviation"] < 1
            assert max(r["copy"] for r in mine) == report[s]["copies_used"] <= {"a": 1, "b": 4, "c": 2}[s]
            whole, block = {}, {}
            for r in mine:  # parts of a document lie side by side, blocks hold no more than their size
                whole.setdefault((r["doc_id"], r["copy"]), []).append((r["first"], r["tokens"]))
                block[r["block"]] = block.get(r["block"], 0) + r["tokens"]
            assert max(block.values()) <= 50 and all(n == 50 for k, n in block.items() if k < max(block))
            cut = [k for k, v in whole.items() if sum(n for _, n in v) != tokens[k[0]]]
            assert len(cut) <= 1 and all(a + n == b for v in whole.values() for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:]))
        slots = sorted((r["slot"], r["source"], r["block"]) for r in out)
        assert len({(x[0], x[1]) for x in slots}) == len({x[0] for x in slots})
    assert mix_report(sized(spark, []), targets).where("delivered_tokens > 0").count() == 0
    assert mix_report(sized(spark, rows), targets.limit(0)).count() == 0
    long = mix_schedule(sized(spark, [(1, "a", 1_000), (2, "b", 1_000), (3, "b", None)]), targets, block_tokens=50).collect()
    assert sum(r["tokens"] for r in long if r["source"] == "a") == 1_000 and len([r for r in long if r["doc_id"] == 1]) == 20


def test_no_small_share_is_rounded_away(spark):
    rows = [(i, f"s{i % 1500}", 10) for i in range(6_000)] + [(10_000 + i, "big", 10) for i in range(6_000)] + [(99_999, "odd", 40)]
    for odd in (0.0, 0.00012345):
        wanted = [(f"s{i}", 0.5 / 1500, 1) for i in range(1500)] + [("big", 0.5 - odd, 1), ("odd", odd, 1)]
        targets = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int")
        report = {r["source"]: r["delivered_tokens"] for r in mix_report(sized(spark, rows), targets, block_tokens=20).collect()}
        out = mix_schedule(sized(spark, rows), targets, block_tokens=20).collect()
        sent = dict.fromkeys(report, 0)
        for r in out:
            sent[r["source"]] += r["tokens"]
        assert len(report) == 1501 + (odd > 0) and min(sent.values()) > 0 and report == sent
        assert len({(r["slot"], r["source"]) for r in out}) == len({r["slot"] for r in out})


def test_periods_of_mixes():
    mix = lambda *w: [(f"s{i}", x, 1) for i, x in enumerate(w)]
    assert mix_period(mix(0.16, 0.84), 10**12, 4096, 1000) == ({"s0": 160, "s1": 840}, 1000, 244_140_625)
    assert mix_period(mix(0.0014, 0.9986), 10**12, 4096, 1000) == ({"s0": 7, "s1": 4993}, 5000, 244_140_625)
    for total in (10_000, 10**12):
        for weights in ((0.0000123456789, 0.5, 0.3), (2.0, 3.0, 0.00001), tuple(1 / 3001 for _ in range(3000)), (3.14159e-7, 0.9)):
            wanted = mix(*weights)
            shares, period, _ = mix_period(wanted, total, 4, 1000)
            assert min(shares.values()) >= 1 and sum(shares.values()) <= period <= mixing.MAX_PERIOD + len(wanted)
            assert len(pfair_period(shares, period)) == sum(shares.values())
            if total == 10_000:  # nothing runs past the end of the mix
                slots = max(-(-total // 4), sum(-(-int(w * total) // 4) for _, w, _ in wanted))
                blocks = {s: -(-int(w * total) // 4) for s, w, _ in wanted}
                assert period % slots == 0 or all(blocks[s] <= -(-slots * n // period) for s, n in shares.items())


def test_names_are_taken_apart():
    x = take_apart("[字]孤独な転校生 Trémolo2 第3回「逆さの図書室とカメラの行方」[再]")
    assert (x["base"], x["season"], x["number"], x["subtitle"]) == ("孤独な転校生trémolo", 2, "3", "逆さの図書室とカメラの行方")
    x = take_apart("＜アニメ便り＞はぐれ鍵盤とJuniper▼ep.11 旅するギターを探して")
    assert (x["number"], x["subtitle"]) == ("11", "旅するギターを探して")
    assert take_apart("青いレンズ Frontier 第9話〜第11話 一挙放送")["several"] and take_apart("雪解けのランタンHa… #12")["cut"]
    assert take_apart("Étoile 第二十四話")["number"] == "24" and take_apart("")["base"] == "" and take_apart("x" * 20_000)["number"] is None
    assert edit_distance("abcd", "abdc", 2) == 1 and edit_distance("abcd", "xyzw", 2) == 3


def test_belief_propagation_is_exact_on_a_tree(spark):
    import itertools
    import math

    pairs = [("a1", "b1", 2.0), ("a1", "b2", 1.0), ("a2", "b2", 0.5), ("a3", "b3", -1.0)]
    weights = dict.fromkeys(range(4), 0.0)
    z = 0.0
    for on in itertools.product((0, 1), repeat=4):
        chosen = [p for p, o in zip(pairs, on) if o]
        if len({p[0] for p in chosen}) == len(chosen) == len({p[1] for p in chosen}):
            w = math.exp(sum(p[2] for p in chosen))
            z += w
            for i in range(4):
                weights[i] += w * on[i]
    got = {(r["a"], r["b"]): r["marginal"] for r in belief_propagation(spark.createDataFrame(pairs, "a string, b string, odds double"), rounds=60, tolerance=1e-6).collect()}
    for i, (a, b, _) in enumerate(pairs):
        assert got[(a, b)] == pytest.approx(weights[i] / z, abs=1e-3)
    assert belief_propagation(spark.createDataFrame([], "a string, b string, odds double")).count() == 0


def exact_marginals(pairs, again):
    """By enumeration: an a takes part in one pair at most; pairs of one b beyond the first each multiply the weight by ``again``."""
    import itertools
    import math

    total, sums = 0.0, [0.0] * len(pairs)
    for on in itertools.product((0, 1), repeat=len(pairs)):
        chosen = [p for p, o in zip(pairs, on) if o]
        if len({p[0] for p in chosen}) < len(chosen):
            continue
        more = len(chosen) - len({p[1] for p in chosen})
        w = math.exp(sum(p[2] for p in chosen)) * (again**more if more else 1.0)
        total += w
        sums = [s + w * o for s, o in zip(sums, on)]
    return [s / total for s in sums]


def test_belief_propagation_with_reruns_is_exact_on_a_tree(spark):
    pairs = [("a1", "b1", 3.0), ("a2", "b1", 1.0), ("a3", "b1", 0.5), ("a2", "b2", 1.0), ("a4", "b4", 0.3)]
    for again in (0.0, 0.3):
        got = {(r["a"], r["b"]): r for r in belief_propagation(spark.createDataFrame(pairs, "a string, b string, odds double"), tolerance=1e-6, again=again).collect()}
        assert all(r["settled"] for r in got.values())
        for (a, b, _), want in zip(pairs, exact_marginals(pairs, again)):
            assert got[a, b]["marginal"] == pytest.approx(want, abs=1e-3), (again, a, b)


def test_loopy_graphs_decide_what_single_nodes_cannot(spark):
    # three broadcasts, three episodes, each broadcast torn between two or three: a loop; both sides have more than one pair
    pairs = [("a1", "b1", 2.0), ("a1", "b2", 0.5), ("a2", "b1", 2.0), ("a2", "b2", 1.8), ("a2", "b3", 0.2), ("a3", "b2", 1.0), ("a3", "b3", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, odds double")
    assert min(df.groupBy("a").count().agg({"count": "avg"}).first()[0], df.groupBy("b").count().agg({"count": "avg"}).first()[0]) > 2
    got = {(r["a"], r["b"]): r["marginal"] for r in belief_propagation(df, again=0.02).collect()}
    exact = dict(zip([p[:2] for p in pairs], exact_marginals(pairs, 0.02)))
    alone = exact_marginals([p for p in pairs if p[0] == "a2"], 0.0)
    best = lambda m, a: max((p[:2] for p in pairs if p[0] == a), key=lambda k: m[k])
    assert all(best(got, a) == best(exact, a) for a in ("a1", "a2", "a3")) and max(abs(got[k] - exact[k]) for k in got) < 0.15
    # on its own a2 would take b1, as a1 does
    assert alone[0] == max(alone) and best(got, "a2") == ("a2", "b2") and best(got, "a3") == ("a3", "b3")


def test_messages_that_never_rest_are_reported(spark):
    pairs = [(f"a{i}", f"b{j}", 6.0) for i in range(3) for j in range(3)]
    out = belief_propagation(spark.createDataFrame(pairs, "a string, b string, odds double"), rounds=2, tolerance=1e-9).collect()
    assert len(out) == 9 and not any(r["settled"] for r in out)


def test_heard_titles(spark):
    said = spark.createDataFrame([(1, "月影の庭師と剣舞の夜"), (1, "月影の庭師と険舞の夜"), (1, "x"), (2, "月影の庭師と剣舞の夜")], "work_id long, text string")
    titles = spark.createDataFrame([(1, "月影の庭師と剣舞の夜"), (1, "月影の庭師と剣舞の朝"), (1, "y")], "work_id long, title string")
    heard = {(r["work_id"], r["text"]): r["heard"] for r in heard_titles(said, titles).collect()}
    assert set(heard) == {(1, "月影の庭師と剣舞の夜"), (1, "月影の庭師と険舞の夜")}
    assert heard[1, "月影の庭師と剣舞の夜"] == {"月影の庭師と剣舞の夜": 1.0} and len(heard[1, "月影の庭師と険舞の夜"]) == 2


def test_blocking_finds_what_brute_force_finds(spark):
    from linkloom.llm.entity import candidate_titles, title_likeness

    rng = random.Random(11)
    parts = ["深い", "遠い", "黒い", "ペンギン", "パズル", "狐火", "ランタン", "harbor", "nocturne", "tempest", "の旅", "航路", "庭師", "デパート"]
    works = sorted({"".join(rng.sample(parts, 3)) for _ in range(150)})
    titles = []
    for n, w in enumerate(works):
        t = list(w)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [t[k], "ン"], ["ヌ"]])
        titles.append(("".join(t)[: 8 if n % 9 == 0 else 99], n % 9 == 0, ""))
    known = spark.createDataFrame([(i, (w, None, [])) for i, w in enumerate(works)], "work_id long, p struct<base:string,season:int,words:array<string>>")
    found = {(r["base"], r["cut"], r["work_id"]) for r in candidate_titles(spark.createDataFrame(titles, "base string, cut boolean, words string").distinct(), known).collect()}
    exact = set(works)
    want = {(b, c, i) for b, c, _ in titles for i, w in enumerate(works) if (b == w if b in exact else title_likeness(b, c, w) >= 0.65)}
    assert found <= want and len(found) >= 0.9 * len(want), (len(found), len(want))
    assert {x for x in want if x[0] in exact} <= found


def test_no_title_that_meets_the_threshold_is_left_out(spark):
    from linkloom.llm.entity import candidate_titles, title_likeness

    rng = random.Random(5)
    parts = ["深い", "遠い", "黒い", "ペンギン", "パズル", "狐火", "ランタン", "harbor", "nocturne", "tempest", "の旅", "航路", "庭師", "デパート"]
    works = sorted({"".join(rng.sample(parts, rng.randint(1, 4))) for _ in range(200)} | {"虹", "ab"})
    titles = {("ba", False, ""), ("霧", False, ""), ("", False, "")}
    for n, w in enumerate(works):
        t = list(w)
        for _ in range(int(0.35 * len(w))):  # as many edits as the threshold allows, swaps of neighbours among them
            k = rng.randrange(len(t))
            if k + 1 < len(t) and rng.random() < 0.5:
                t[k], t[k + 1] = t[k + 1], t[k]
            else:
                t[k : k + 1] = rng.choice([[], [t[k], "ン"], ["ヌ"]])
        titles.add(("".join(t)[: rng.randint(2, 8) if n % 5 == 0 else 99] + ("第一夜の手紙" if n % 7 == 1 else ""), n % 5 == 0, ""))
    known = spark.createDataFrame([(i, (w, None, [])) for i, w in enumerate(works)], "work_id long, p struct<base:string,season:int,words:array<string>>")
    rows = spark.createDataFrame(sorted(titles), "base string, cut boolean, words string")
    want = {(b, c, i) for b, c, _ in titles for i, w in enumerate(works) if (b == w if b in works else title_likeness(b, c, w) >= 0.65)}
    for cell in (20_000, 60):
        found = [(r["base"], r["cut"], r["work_id"]) for r in candidate_titles(rows, known, cell=cell).collect()]
        assert set(found) == want and len(found) == len(want), (cell, len(want - set(found)), len(set(found) - want))
    assert candidate_titles(rows.limit(0), known).count() == 0 and candidate_titles(rows, known.limit(0)).count() == 0


def test_titles_are_judged_many_at_once_as_one_by_one():
    from linkloom.llm.entity import _Letters, _forms, _plain_table, title_likeness
    from linkloom.llm.near_titles import likenesses

    rng = random.Random(8)
    texts = ["", "a", "虹"] + ["".join(rng.choices("abcかキ霧", k=rng.randint(1, 16))) for _ in range(60)]
    rows = [(a, c, b) for a in texts for b in texts for c in (False, True)]
    assert likenesses(rows) == [title_likeness(*r) for r in rows] and likenesses([]) == []
    # letters that stand for themselves are looked up once
    assert isinstance(_forms(), _Letters) and isinstance(_plain_table(), _Letters)


T0 = 1_784_500_000_000


def tables(spark):
    works = spark.createDataFrame([(1, "孤独な転校生 Trémolo", "11", 3), (2, "孤独な転校生 Trémolo 第2期", "12", 3), (3, "白い黒猫 Prélude", None, 3), (4, None, "0", None)], "id int, title string, syobocal_tid string, episodes_count int")
    eps = [(100 * w + n, w, f"第{n}話", 10 * n, f"{w}作目の{n}番の手紙と{chr(0x30A2 + 7 * n + w)}の夜") for w in (1, 2, 3) for n in (1, 2, 3)] + [(999, 4, None, None, None)]
    episodes = spark.createDataFrame(eps, "id int, work_id int, number_text string, sort_number int, title string")
    progs = [(1, 11, 5, 2, T0, "1作目の2番の手紙とンの夜", False), (2, 12, 5, 3, T0 + 3_600_000, None, False), (3, 77, 5, 1, T0 + 7_200_000, "知らない", False), (4, None, None, None, None, None, None)]
    programs = spark.createDataFrame([(*p, "x") for p in progs], "pid int, tid int, channel_id int, count int, t long, subtitle string, deleted boolean, loaded_at string").withColumn("started_at", F.timestamp_millis("t")).drop("t")
    channels = spark.createDataFrame([(5, 500), (None, 1)], "channel_id int, history_id long")
    labels = spark.createDataFrame([(n + 1, f"第{n}話") for n in range(10)], "label_id int, label string")
    return works, episodes, programs, channels, labels


def test_match_recordings(spark):
    works, episodes, programs, channels, labels = tables(spark)
    recs = [
        (1, 500, T0 + 5_000, "[字]孤独な転校生 Trémolo"),  # the schedule tells the number
        (1, 500, T0 + 5_000, "[字]孤独な転校生 Trémolo"),
        (2, 500, T0 + 3_605_000, "孤独な転校生 Trémolo 第3話"),  # and the season
        (3, 999, T0, "白い黒猫 Prelude 第2話"),  # no channel: the name alone
        (4, 500, T0 + 1_000, "料理のてびき 騎士と茶房"),
        (5, None, None, None),
        (6, 500, T0, "孤独な転校生 Trémolo 第1話〜第3話 一挙放送"),
        (7, None, T0, "白い黒猫 Prélude 第9話"),
    ]
    rec = spark.createDataFrame([(*r, "l") for r in recs], "id long, channel_id long, start_at long, name string, loaded_at string")
    found = {(r["recording_id"], r["episode_id"]) for r in match_recordings(works, episodes, programs, channels, rec, labels).where("confidence > 0.5").collect()}
    assert found == {(1, 102), (2, 203), (3, 302)}
    assert match_recordings(works, episodes, programs, channels, rec.limit(0), labels).count() == 0
