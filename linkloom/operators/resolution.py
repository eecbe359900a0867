"""Resolution: one answer or none.

Each operator turns evidence rows into at most one answer a group and says why there is none: ambiguity is a result.
All are groupings with partial aggregation or single joins, so a hot group costs one summed row a map task; windows are
used only where the rank itself is the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def unique_or_null(df: DataFrame, keys: Sequence[str], value: str, distinct: bool = False, out: str = "value", count: str = "candidates") -> DataFrame:
    """The value of each group that has exactly one row (``distinct``: one distinct non-null value), else null, and the count."""
    n = F.countDistinct(value) if distinct else F.count("*")
    g = df.groupBy(*keys).agg(n.alias(count), F.min(value).alias(out))
    return g.select(*keys, F.when(F.col(count) == 1, F.col(out)).alias(out), count)


def unanimous(df: DataFrame, keys: Sequence[str], value: str, usable: Column, out: str = "value") -> DataFrame:
    """For groups with usable rows: how many, how many distinct values, and the value if they all have the same one.

    A usable row without a value breaks unanimity. Groups without usable rows have no row.
    """
    g = df.where(usable).groupBy(*keys).agg(F.count("*").alias("usable"), F.countDistinct(value).alias("kinds"), F.count(value).alias("__with"), F.min(value).alias(out))
    agreed = (F.col("kinds") == 1) & (F.col("__with") == F.col("usable"))
    return g.select(*keys, "usable", "kinds", F.when(agreed, F.col(out)).alias(out))


def corroborated(df: DataFrame, keys: Sequence[str], value: str, witness: str, doubtful: Column, text: str, least: int = 2) -> DataFrame:
    """Groups of doubtful rows alone that ``least`` witnesses tell alike: all rows have a witness and a text, and one value."""
    said = F.coalesce(F.length(F.trim(F.col(text))) > 0, F.lit(False))
    g = df.groupBy(*keys).agg(
        F.bool_and(F.coalesce(doubtful, F.lit(False))).alias("__doubt"),
        F.bool_and(F.coalesce(F.col(witness) > 0, F.lit(False)) & said).alias("__told"),
        F.countDistinct(witness).alias("witnesses"),
        F.countDistinct(value).alias("__kinds"),
        F.bool_and(F.col(value).isNotNull()).alias("__all"),
        F.min(value).alias("value"),
    )
    return g.where((F.col("__doubt")) & F.col("__told") & (F.col("witnesses") >= least) & (F.col("__kinds") == 1) & F.col("__all")).select(*keys, "value", "witnesses")


def anchors(df: DataFrame, group: str, mark: Sequence[str], witness: str, order: Sequence[str], least: int = 2) -> DataFrame:
    """(group, marks, witness): groups of which ``least`` distinct marks have one and the same witness.

    A mark counts with the witness that comes first by ``order``: later repeats of a mark neither confirm nor contradict.
    """
    first = df.where(F.col(witness).isNotNull()).groupBy(group, *mark).agg(F.min_by(witness, F.struct(*order, witness)).alias("w"))
    g = first.groupBy(group).agg(F.count("*").alias("marks"), F.countDistinct("w").alias("__w"), F.min("w").alias("witness"))
    return g.where((F.col("marks") >= least) & (F.col("__w") == 1)).select(group, "marks", "witness")


def final_number(df: DataFrame, group: str, number: str) -> DataFrame:
    """The greatest number of each group whose numbers are distinct and without a gap (null otherwise), and the count."""
    g = df.where(F.col(number).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    whole = (F.col("n") == F.col("d")) & (F.col("hi") - F.col("lo") + 1 == F.col("d"))
    return g.select(group, F.when(whole, F.col("hi")).alias("final"), F.col("n").alias("members"))


def ordinals(df: DataFrame, group: str, order: str, keep: Sequence[str]) -> DataFrame:
    """The rank of each row in its group, for groups whose order keys are all positive and distinct; others have no rows."""
    good = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(order).alias("d"), F.min(F.coalesce(F.col(order), F.lit(0))).alias("lo")).where("n = d and lo > 0").select(group)
    w = Window.partitionBy(group).orderBy(order)
    return df.join(good, group, "left_semi").select(group, *keep, F.row_number().over(w).alias("ordinal"))


def local_ordinals(df: DataFrame, group: str, order: str, number: str, keep: Sequence[str]) -> DataFrame:
    """Local numbers (from 1) of groups that count on from an earlier part: contiguous in ``order``, first above 1."""
    ranked = ordinals(df, group, order, [*keep, number])
    off = F.col(number) - F.col("ordinal")
    good = ranked.groupBy(group).agg(F.count("*").alias("n"), F.count(number).alias("c"), F.min(off).alias("lo"), F.max(off).alias("hi")).where("n = c and lo = hi and lo > 0").select(group)
    return ranked.join(good, group, "left_semi").select(group, *keep, number, F.col("ordinal").alias("local"))


def longest_list(df: DataFrame, family: str, member: str, number: str, order: str) -> DataFrame:
    """For each family the member with the most rows (of several the first by ``order``), its size and greatest number."""
    sizes = df.groupBy(family, member).agg(F.count("*").alias("size"), F.max(number).alias("top"), F.min(order).alias("__o"))
    best = sizes.groupBy(family).agg(F.max_by(F.struct(member, "size", "top"), F.struct("size", -F.col("__o"), -F.col(member))).alias("b"))
    return best.select(family, F.col("b")[member].alias(member), F.col("b.size").alias("size"), F.col("b.top").alias("top"))


def disjoint(df: DataFrame, family: str, number: str) -> DataFrame:
    """Whether the numbers of all members of a family are distinct, so that their lists can be read as one."""
    g = df.where(F.col(number).isNotNull()).groupBy(family).agg(F.count("*").alias("n"), F.countDistinct(number).alias("d"))
    return g.select(family, F.col("n").alias("numbers"), (F.col("n") == F.col("d")).alias("disjoint"))


def page_integrity(df: DataFrame, key: str, declared: Column) -> DataFrame:
    """One row: rows, distinct keys, and whether a paged result is whole: keys unique, one declared total, and reached."""
    g = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.countDistinct(declared).alias("__t"), F.max(declared).alias("__m"))
    return g.select("rows", "keys", ((F.col("rows") == F.col("keys")) & (F.col("__t") == 1) & (F.col("rows") == F.col("__m"))).alias("whole"))


def priority_tiers(df: DataFrame, keys: Sequence[str], tier: str, value: str, tiers: Sequence[tuple[str, bool]]) -> DataFrame:
    """The answer of the first tier with exactly one candidate.

    ``tiers`` names them in order, each with whether ambiguity in it vetoes all that follow. Columns: value, tier, reason.
    """
    g = df.groupBy(*keys).agg(
        *[F.count(F.when(F.col(tier) == t, 1)).alias(f"__n{i}") for i, (t, _) in enumerate(tiers)],
        *[F.min(F.when(F.col(tier) == t, F.col(value))).alias(f"__v{i}") for i, (t, _) in enumerate(tiers)],
    )
    answer, which, reason = F.lit(None), F.lit(None).cast("string"), F.lit("no candidate")
    for i in range(len(tiers) - 1, -1, -1):
        name, veto = tiers[i]
        n = F.col(f"__n{i}")
        answer, which, reason = (
            F.when(n == 1, F.col(f"__v{i}")).when((n > 1) & F.lit(veto), F.lit(None)).otherwise(answer),
            F.when(n == 1, F.lit(name)).when((n > 1) & F.lit(veto), F.lit(None)).otherwise(which),
            F.when(n == 1, F.lit("unique")).when((n > 1) & F.lit(veto), F.lit(f"ambiguous {name}")).otherwise(reason),
        )
    return g.select(*keys, answer.alias("value"), which.alias("tier"), reason.alias("reason"))


def cross_group(df: DataFrame, keys: Sequence[str], resolved: Column, failed: Column, value: str) -> DataFrame:
    """Answers of several groups for one key: the value if exactly one group is resolved and no lookup failed."""
    g = df.groupBy(*keys).agg(F.count_if(resolved).alias("resolved"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"), F.min(F.when(resolved, F.col(value))).alias("v"))
    return g.select(*keys, "resolved", "failed", F.when((F.col("resolved") == 1) & (F.col("failed") == 0), F.col("v")).alias("value"))


def agree_or_conflict(a: Column, b: Column) -> tuple[Column, Column]:
    """(value, conflict): two tellings of one fact; either may be missing, but not contradict the other."""
    clash = a.isNotNull() & b.isNotNull() & (a != b)
    return F.when(~clash, F.coalesce(a, b)), clash


def contains_pairs(short: DataFrame, long: DataFrame, n: int = 3) -> DataFrame:
    """(short, long) of distinct texts k where ``long`` contains ``short``, blocked by the rarest run of ``n`` characters of the short one.

    Every run of the long text is a block key, so no pair is missed, and a run that many share, such as a common beginning,
    is a key only for texts that have no rarer one. Texts shorter than ``n`` block by all they have.
    """
    runs = lambda c, w: F.transform(F.sequence(F.lit(1), F.length(c) - w + 1), lambda i: F.substr(c, i, w))
    texts = long.select(F.col("k").alias("long")).where(F.length("k") > 0).distinct()
    every = F.flatten(F.array(*[F.when(F.length("long") >= w, runs(F.col("long"), F.lit(w))).otherwise(F.array().cast("array<string>")) for w in range(1, n + 1)]))
    grams = texts.select("long", F.explode(F.array_distinct(every)).alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("n"))
    s = short.select(F.col("k").alias("short")).where(F.length("k") > 0).distinct()
    own = s.select("short", F.explode(F.array_distinct(runs(F.col("short"), F.least(F.lit(n), F.length("short"))))).alias("g")).join(counts, "g", "left")
    # a text of which no long one has some run stands in none
    rarest = own.groupBy("short").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.count_if(F.col("n").isNull()).alias("gone")).where("gone = 0").select("short", "g")
    return rarest.join(grams, "g").where(F.contains("long", "short")).select("short", "long").distinct()


def tiered_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, id, right_id, tier): left(id, exact, k) against right(id, exact, k) by exact text, then key, then containment either way.

    A later tier is asked only for left rows without a match in the earlier ones. Null and empty texts match nothing.
    """
    rt = right.select(F.col("id").alias("right_id"), F.col("exact").alias("rx"), F.col("k").alias("rk"))
    lf = left.select("id", "exact", "k")
    one = lf.where("exact <> ''").join(rt.where("rx <> ''"), F.col("exact") == F.col("rx")).select("id", "right_id", F.lit("exact").alias("tier"))
    rest = lf.join(one.select("id").distinct(), "id", "left_anti")
    two = rest.where("k <> ''").join(rt.where("rk <> ''"), F.col("k") == F.col("rk")).select("id", "right_id", F.lit("key").alias("tier"))
    rest = rest.join(two.select("id").distinct(), "id", "left_anti")
    lk, rk = rest.select("k"), rt.select(F.col("rk").alias("k"))
    pairs = contains_pairs(lk, rk).select(F.col("short").alias("k"), F.col("long").alias("rk")).unionByName(contains_pairs(rk, lk).select(F.col("long").alias("k"), F.col("short").alias("rk"))).distinct()
    three = rest.join(pairs, "k").join(rt, "rk").select("id", "right_id", F.lit("contains").alias("tier"))
    return one.unionByName(two).unionByName(three).distinct()


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides that share a key which is unique on either side."""
    lone = lambda d: d.join(d.groupBy(key).count().where("count = 1").select(key), key, "left_semi")
    return lone(left.where(F.col(key).isNotNull())).join(lone(right.where(F.col(key).isNotNull())), key)


def override(df: DataFrame, dimension: DataFrame, on: Sequence[str], columns: Sequence[str], limit: int = 10_000) -> DataFrame:
    """``df`` with ``columns`` replaced where a fixed dimension has them. The dimension is refused beyond ``limit`` rows."""
    if dimension.limit(limit + 1).count() > limit:
        raise ValueError("the dimension is too large to be fixed")
    side = dimension.select(*on, *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = df.join(F.broadcast(side), list(on), "left")
    return out.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def top_one(df: DataFrame, group: str, score: Column, order: Sequence[str], keep: Sequence[str], least: int = 1) -> DataFrame:
    """The row of each group with the greatest score (of equal ones the first by ``order``), if it reaches ``least``."""
    row = F.struct(score.alias("score"), *_cols(keep))
    rank = F.struct(score, *[-F.col(c).cast("long") for c in order])
    best = df.groupBy(group).agg(F.max_by(row, rank).alias("b"))
    return best.select(group, *[F.col("b")[c].alias(c) for c in ("score", *keep)]).where(F.col("score") >= least)


def number_duplicates(df: DataFrame, target: str, order: Sequence[str], key: str) -> DataFrame:
    """(key, target, copy): 0 for the first claimant of a target, then 1, 2, ..."""
    return df.select(key, target, (F.row_number().over(Window.partitionBy(target).orderBy(*order)) - 1).alias("copy"))


def fresh(df: DataFrame, at: str, now: Column, ttl: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Rows of a cache that are at most ``ttl`` old and not from the future."""
    return df.where((F.col(at) <= now) & (F.col(at) >= now - F.expr(ttl)))


def refreshed(cache: DataFrame, answers: DataFrame, key: str, at: str) -> DataFrame:
    """A cache with new answers laid over it: the row of each key that is newest by ``at``, of equal ones the answer's.

    Rows without a key or a time are dropped. Both sides have the same columns.
    """
    both = cache.withColumn("__new", F.lit(0)).unionByName(answers.withColumn("__new", F.lit(1))).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rest = [c for c in cache.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*_cols(rest)), F.struct(F.col(at), F.col("__new"))).alias("__row"))
    return best.select(key, *[F.col("__row")[c].alias(c) for c in rest])


def free_copies(plan: DataFrame, existing: DataFrame, target: str, order: Sequence[str], key: str) -> DataFrame:
    """(key, target, copy): numbers of claimants of a target, behind the ``existing``(target) that stand there already."""
    there = existing.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("__there"))
    numbered = number_duplicates(plan, target, order, key)
    return numbered.join(there, target, "left").select(key, target, (F.col("copy") + F.coalesce("__there", F.lit(0))).cast("int").alias("copy"))


def conflicting(new: DataFrame, existing: DataFrame, place: str, identity: str) -> DataFrame:
    """(place, identity, others): rows of ``new`` whose place already has another identity, or several; they must not be written."""
    there = existing.where(F.col(place).isNotNull() & F.col(identity).isNotNull()).groupBy(place).agg(F.min(identity).alias("__lo"), F.max(identity).alias("__hi"), F.countDistinct(identity).cast("int").alias("others"))
    j = new.where(F.col(place).isNotNull() & F.col(identity).isNotNull()).select(place, identity).distinct().join(there, place)
    return j.where((F.col("__lo") != F.col(identity)) | (F.col("__hi") != F.col(identity))).select(place, identity, "others")


def exact_lookup(asked: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, status) for each distinct key asked: 'found' where exactly one row has it, else 'none' or 'several'."""
    g = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("v"))
    j = asked.where(F.col(key).isNotNull()).select(key).distinct().join(g, key, "left")
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "several").otherwise("none")
    return j.select(key, F.when(F.col("n") == 1, F.col("v")).alias(value), status.alias("status"))
