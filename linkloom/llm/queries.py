"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import entity, label_trie, leaks, lookalike, mixing, mojibake, nearest_time, stuffing
from linkloom.sources import latest, table

Query = Callable[[SparkSession, str], DataFrame]


# ---- 1: recordings and episodes ----------------------------------------------------------------------------------------


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every recording's candidate episodes with their confidence."""
    return entity.match_recordings(
        table(spark, folder, "works", "id", "title", "syobocal_tid", "episodes_count"),
        table(spark, folder, "episodes", "id", "work_id", "number_text", "sort_number", "title"),
        table(spark, folder, "schedule_programs", "pid", "tid", "channel_id", "count", "started_at", "subtitle", "deleted", "loaded_at"),
        table(spark, folder, "schedule_channels", "channel_id", "history_id"),
        table(spark, folder, "recordings", "id", "channel_id", "start_at", "name", "loaded_at"),
        table(spark, folder, "episode_labels", "label_id", "label"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_matches(spark, folder).where("confidence > 0.5").select("episode_id", "recording_id").distinct()


# ---- 2: labels ---------------------------------------------------------------------------------------------------------


def p2_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every label typed in either table with the entry meant (0: none) and all entries within its distance."""
    typed = [
        table(spark, folder, t, key, column).select(F.lit(t).alias("tbl"), F.col(key).cast("long").alias("record_id"), F.col(column).alias("label"))
        for t, key, column in (("episodes", "id", "number_text"), ("recording_metadata", "meta_id", "episode_label"))
    ]
    both = reduce(DataFrame.unionByName, typed).where("label is not null and record_id is not null")
    return label_trie.map_labels(both, "label", table(spark, folder, "episode_labels", "label_id", "label")).where("label_id is not null")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_labels(spark, folder).where("not label_exact").select("tbl", "record_id", "label_id").distinct()


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Labels without an entry, and how often they are typed."""
    return p2_labels(spark, folder).where("label_id = 0").groupBy("label").agg(F.count("*").alias("uses"))


# ---- 3: nearest time ---------------------------------------------------------------------------------------------------


def p3_nearest(spark: SparkSession, folder: str, tolerance_ms: int = 300_000) -> DataFrame:
    channels = table(spark, folder, "schedule_channels", "channel_id", "history_id").where("channel_id is not null and history_id is not null").distinct()
    recs = latest(table(spark, folder, "recordings", "id", "channel_id", "start_at", "loaded_at"), "id").withColumnRenamed("channel_id", "history_id")
    left = recs.join(channels, "history_id").select(F.col("channel_id").alias("key"), F.col("id").cast("long").alias("id"), F.col("start_at").alias("time_ms"))
    rows = latest(table(spark, folder, "schedule_programs", "pid", "channel_id", "started_at", "deleted", "loaded_at"), "pid").where("deleted = false")
    right = rows.select(F.col("channel_id").alias("key"), F.col("pid").cast("long").alias("id"), F.unix_millis(F.col("started_at").cast("timestamp")).alias("time_ms"))
    return nearest_time.nearest_in_time(left, right, tolerance_ms)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_nearest(spark, folder).select(F.col("right_id").alias("pid"), F.col("left_id").alias("recording_id")).distinct()


# ---- 5: garbled text ---------------------------------------------------------------------------------------------------


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Names and descriptions of broadcasts, judged and restored; redelivered rows count once."""
    rows = table(spark, folder, "broadcasts", "broadcast_id", "name", "description")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("name", "description")])).alias("x")
    texts = rows.select("broadcast_id", fields).select("broadcast_id", "x.field", "x.text").where("text is not null and broadcast_id is not null").distinct()
    return mojibake.find_garbled(texts)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_texts(spark, folder).where("garbled").select(F.col("broadcast_id").cast("long").alias("broadcast_id"), "field").distinct()


# ---- 6: look-alikes ----------------------------------------------------------------------------------------------------


def _values(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, t, key, column).select(F.lit(t).alias("tbl"), F.col(key).cast("long").alias("id"), F.col(column).alias("text"))
        for t, key, column in (("works", "id", "title"), ("episodes", "id", "title"), ("recordings", "id", "name"), ("schedule_programs", "pid", "subtitle"))
    ]
    return reduce(DataFrame.unionByName, parts).where("text is not null").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(_values(spark, folder))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every value with its form and class."""
    return lookalike.lookalike_classes(_values(spark, folder))


# ---- 7: leaks ----------------------------------------------------------------------------------------------------------


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item, and how much of it at most."""
    return p7_leaks(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("run_share").alias("most"))


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without leaked spans; those that are mostly leaks are gone."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    return leaks.remove_leaks(documents, p7_leaks(spark, folder)).select("doc_id", "text", "leak_items", "leak_chars")


# ---- 8: mixing ---------------------------------------------------------------------------------------------------------


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.sized_documents(table(spark, folder, "documents", "doc_id", "source", "text"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).where("not filled").select("source")


def p8_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_schedule(_sized(spark, folder), table(spark, folder, "mix_targets"))


# ---- 9: stuffed pages --------------------------------------------------------------------------------------------------


def p9_pages(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, folder, "documents", "doc_id", "site", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pages(spark, folder).where("stuffed").select("doc_id").distinct()


def queries() -> dict[str, Query]:
    found = [p1_found, p2_found, p3_found, p5_found, p6_found, p7_found, p8_found, p9_found]
    more = [p1_matches, p2_unmatched, p3_nearest, p5_texts, p6_classes, p7_items, p7_cleaned, p8_report, p8_schedule, p9_pages]
    return {q.__name__: q for q in found + more}
