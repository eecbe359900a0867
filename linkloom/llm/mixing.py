"""Mixing sources to target weights by Pfair scheduling.

A source of weight w is a stream of blocks of equal size; its k-th block may be emitted from slot floor(k / w) on and must
be emitted before slot ceil((k + 1) / w). Earliest-deadline-first over these windows keeps every source within one block
of its fluid share at any moment. Weights are whole shares of a period, after which all deviations are zero again, so one
period, of bounded length, is scheduled and holds for every later one: the slot of any block then follows by arithmetic,
and documents are placed without any order over the whole corpus being made in one task. The period is chosen from the
targets, so that no source's share is rounded away: see ``mix_period``.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.session import checkpointed

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern of the byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sources that a mix may name: their rows, and one period of the schedule, are held on the driver.
MAX_SOURCES = 10_000
#: Slots of a period held on the driver; only a longer mix whose shares are whole in no shorter period is approximated.
MAX_PERIOD = 200_000


#: Bytes of a vocabulary that go to every worker.
MAX_VOCABULARY = 64_000_000


@lru_cache(maxsize=4)
def _encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("bytes", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(spark: SparkSession, vocabulary: str = DEFAULT_VOCABULARY):
    """A function of a text column: its tokens in a byte-level vocabulary (special tokens are ordinary text); null is 0.

    The vocabulary is read on the driver and sent to the workers, which need no such file; it is refused beyond MAX_VOCABULARY.
    """
    if os.path.getsize(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary may have at most {MAX_VOCABULARY} bytes")
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(sent.value).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def period_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integer shares of ``period`` slots by largest remainder; together they fill it as far as the weights sum to 1."""
    total = sum(weights.values())
    if total > 1 + 1e-9:
        weights = {k: w / total for k, w in weights.items()}
    exact = {k: w * period for k, w in weights.items()}
    whole = {k: int(x + 1e-9) for k, x in exact.items()}
    spare = min(period, round(sum(exact.values()))) - sum(whole.values())
    for k in sorted(exact, key=lambda k: (whole[k] - exact[k], k))[: max(0, spare)]:
        whole[k] += 1
    return whole


def mix_period(wanted: list[tuple[str, float, int]], total: int, block_tokens: int, period: int) -> tuple[dict[str, int], int, int]:
    """(share of each source, slots of the period they are shares of, slots of the mix): every source of ``wanted`` has a slot.

    ``period`` where all shares are whole in it, else the shortest in which they are. Where that is beyond MAX_PERIOD, the
    whole mix is one period, each source with as many slots as its target has blocks. Where that is too long as well,
    shares are rounded up to 1/MAX_PERIOD: nothing of a target is left out, but the mix takes up to 1 + sources/MAX_PERIOD
    times as many slots.
    """
    all_ = sum(w for _, w, _ in wanted)
    weights = {s: w / all_ if all_ > 1 + 1e-9 else w for s, w, _ in wanted}
    length = -(-total // block_tokens)
    exact = {s: Fraction(w).limit_denominator(MAX_PERIOD) for s, w in weights.items()}
    if all(abs(x - weights[s]) <= 1e-12 for s, x in exact.items()) and sum(exact.values()) <= 1:
        least = 1
        for x in exact.values():
            least = math.lcm(least, x.denominator)
            if least > MAX_PERIOD:
                break
        for p in (period, least):
            if p <= MAX_PERIOD and p % least == 0:
                return {s: int(x * p) for s, x in exact.items()}, p, length
    whole = {s: max(1, -(-int(w * total) // block_tokens)) for s, w, _ in wanted}
    slots = max(length, sum(whole.values()))
    if slots <= MAX_PERIOD:
        return whole, slots, slots
    rounded = {s: max(1, math.ceil(w * MAX_PERIOD - 1e-6)) for s, w in weights.items()}
    return rounded, max(MAX_PERIOD, sum(rounded.values())), length


def pfair_period(shares: dict[str, int], period: int) -> list[tuple[str, int, int, int, int]]:
    """One period of the schedule: (source, k, release, deadline, slot) of every block, by earliest deadline first."""
    starts: dict[int, list] = {}
    for source in sorted(shares):
        n = shares[source]
        for k in range(n):
            release, deadline = k * period // n, -(-(k + 1) * period // n)
            starts.setdefault(release, []).append((deadline, source, k, release))
    ready: list = []
    out = []
    for slot in range(period):
        for job in starts.get(slot, ()):
            heapq.heappush(ready, job)
        if ready:
            deadline, source, k, release = heapq.heappop(ready)
            if slot >= deadline:
                raise AssertionError("a deadline was missed")
            out.append((source, k, release, deadline, slot))
    return out


def sized_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of documents(doc_id, source, text); null and empty texts have 0 tokens."""
    return documents.select("doc_id", "source", token_counts(documents.sparkSession, vocabulary)("text").alias("tokens"))


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """Rows without a source or a positive share are no targets; several rows of a source add up, the greater cap holds."""
    share = F.col("target_share").cast("double")
    rows = (
        targets.where(F.col("source").isNotNull() & (share > 0) & ~F.isnan(share))
        .groupBy("source")
        .agg(F.sum(share).alias("w"), F.greatest(F.lit(0), F.max(F.coalesce(F.col("max_repeats"), F.lit(1)))).cast("int").alias("r"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mix may name at most {MAX_SOURCES} sources")
    return sorted((x["source"], x["w"], x["r"]) for x in rows)


def _supplies(sized: DataFrame, names: list[str]) -> tuple[int, dict[str, tuple[int, int]]]:
    """Tokens of all documents (every source, null too), and (documents, tokens) of the named sources."""
    known = F.when(F.col("source").isin(names), F.col("source")) if names else F.lit(None).cast("string")
    rows = sized.groupBy(known.alias("s")).agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()
    return sum(x["t"] or 0 for x in rows), {x["s"]: (x["n"], x["t"] or 0) for x in rows if x["s"] is not None}


REPORT = "source string, target_share double, max_repeats int, documents bigint, tokens bigint, target_tokens bigint, delivered_tokens bigint, blocks bigint, blocks_missed bigint, copies_used int, deviation double, actual_share double, filled boolean"


def _plan(sized: DataFrame, targets: DataFrame, block_tokens: int, period: int, rows_per_bucket: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """(a row for each target, the slots of one period, slots of the period); both tables are bounded by MAX_SOURCES and MAX_PERIOD."""
    spark = sized.sparkSession
    wanted = _targets(targets)
    total, supply = _supplies(sized, [s for s, _, _ in wanted])
    shares, period, _ = mix_period(wanted, total, block_tokens, period)
    rows = []
    for s, w, r in wanted:
        n, t = supply.get(s, (0, 0))
        rows.append((s, w, r, int(w * total), shares[s], n, t, max(1, -(-n // rows_per_bucket))))
    plan = spark.createDataFrame(rows, "source string, weight double, cap int, target bigint, share int, documents bigint, supply bigint, buckets int")
    slots = spark.createDataFrame([(s, k, slot) for s, k, _, _, slot in pfair_period(shares, period)], "source string, k bigint, slot_in_period bigint")
    return plan, slots, period


def mix_schedule(sized: DataFrame, targets: DataFrame, block_tokens: int = 4096, period: int = 1000, rows_per_bucket: int = 200_000) -> DataFrame:
    """The mix itself: (doc_id, source, copy, block, slot, first, tokens), a row for every part of a document in a block.

    A source's documents follow in the order of a hash of their ids, copy after copy, until its target is reached or its
    cap; documents are cut where a block ends and where the target does, ``first`` being the token of the document that
    the part begins with. block is the block of the source's stream, slot its place in the interleaving: read in the order
    of slot, every source stays within one block of its share. Offsets come from sums of buckets, then sums inside a bucket
    of bounded size, so that a source may hold any part of the corpus. Documents with equal ids are all used; empty ones
    are a part of no tokens. ``sized`` is written to the checkpoint folder once.
    """
    return _scheduled(checkpointed(sized), targets, block_tokens, period, rows_per_bucket)[0]


def _scheduled(sized: DataFrame, targets: DataFrame, block_tokens: int, period: int, rows_per_bucket: int) -> tuple[DataFrame, DataFrame, int]:
    plan, slots, period = _plan(sized, targets, block_tokens, period, rows_per_bucket)
    hashed = sized.join(F.broadcast(plan.select("source", "cap", "target", "share", "supply", "buckets")), "source").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", "buckets"))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("tokens").alias("size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source", "bucket"]).withColumn("at", F.col("base") + F.col("inner"))
    # copies that start before the target is reached: c * supply + at < target
    used = placed.where("supply > 0 and at < target and cap > 0")
    used = used.withColumn("copy", F.explode(F.expr("sequence(0L, least(cast(cap as bigint), (target - at + supply - 1) div supply) - 1)"))).withColumn("at", F.expr("copy * supply + at"))
    used = used.withColumn("end", F.expr("least(at + tokens, target)"))
    parts = used.withColumn("block", F.explode(F.expr(f"sequence(at div {block_tokens}L, greatest(at, end - 1) div {block_tokens}L)")))
    low, high = F.greatest("at", F.col("block") * block_tokens), F.least("end", (F.col("block") + 1) * block_tokens)
    parts = parts.select("doc_id", "source", (F.col("copy") + 1).cast("int").alias("copy"), "block", "share", (low - F.col("at")).alias("first"), (high - low).alias("tokens"))
    parts = parts.withColumn("k", F.pmod("block", "share")).join(F.broadcast(slots), ["source", "k"])
    slot = F.expr("block div share") * period + F.col("slot_in_period")
    return parts.select("doc_id", "source", "copy", "block", slot.alias("slot"), "first", "tokens"), plan, period


def mix_report(sized: DataFrame, targets: DataFrame, block_tokens: int = 4096, period: int = 1000, rows_per_bucket: int = 200_000) -> DataFrame:
    """One row per target source: what a mix as large as all documents together gives it, measured on ``mix_schedule``; columns as in REPORT.

    delivered_tokens, blocks and copies_used are those of the scheduled parts, blocks_missed the blocks of the target that
    none of them reaches. deviation is the greatest distance, in blocks, between what a source had and its share of the
    slots passed, over all its blocks. filled is false where the target is not reached. Actual shares are of all tokens
    delivered. Without documents or targets the report is all zero or empty; sources of documents without a target are not
    mixed in but count towards the size.
    """
    parts, plan, period = _scheduled(checkpointed(sized), targets, block_tokens, period, rows_per_bucket)
    # one row for each block first: a block's parts differ only in their tokens
    blocks = parts.groupBy("source", "block", "slot").agg(F.sum("tokens").alias("tokens"), F.max("copy").alias("copy"))
    share = F.col("share") / F.lit(float(period))
    apart = F.greatest(F.abs(F.col("block") + 1 - share * (F.col("slot") + 1)), F.abs(F.col("block") - share * F.col("slot")))
    sent = (
        blocks.join(F.broadcast(plan.select("source", "share")), "source")
        .groupBy("source")
        .agg(F.sum("tokens").alias("given"), F.count_if(F.col("tokens") > 0).alias("blocks"), F.max("copy").alias("copies"), F.max(apart).alias("deviation"))
    )
    rows = plan.join(F.broadcast(sent), "source", "left").withColumns({"given": F.coalesce("given", F.lit(0)), "blocks": F.coalesce("blocks", F.lit(0))})
    all_ = F.sum("given").over(Window.partitionBy())
    return rows.select(
        "source",
        F.col("weight").alias("target_share"),
        F.col("cap").alias("max_repeats"),
        "documents",
        F.col("supply").alias("tokens"),
        F.col("target").alias("target_tokens"),
        F.col("given").cast("long").alias("delivered_tokens"),
        F.col("blocks").cast("long").alias("blocks"),
        F.expr(f"(target + {block_tokens - 1}L) div {block_tokens}L - blocks").alias("blocks_missed"),
        F.coalesce("copies", F.lit(0)).alias("copies_used"),
        F.coalesce("deviation", F.lit(0.0)).alias("deviation"),
        F.coalesce(F.try_divide("given", all_), F.lit(0.0)).cast("double").alias("actual_share"),
        (F.col("given") >= F.col("target")).alias("filled"),
    )
