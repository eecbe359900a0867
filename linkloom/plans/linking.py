"""Queries of name parsing, text keys and the linking pipeline (no SQL can express them: tested in tests/)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions.names import headers
from linkloom.operators import linking
from linkloom.plans.catalogue import programs
from linkloom.sources import table


def e01_parsed_names(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of every recording's path."""
    files = table(spark, folder, "recording_metadata", "meta_id", "path").select(F.col("meta_id").alias("rec"), "path")
    return linking.parse_recordings(files).withColumnRenamed("rec", "meta_id")


def e20_description_headers(spark: SparkSession, folder: str) -> DataFrame:
    """What the descriptions of broadcasts tell of their episodes, where they begin with a mark."""
    b = table(spark, folder, "broadcasts", "broadcast_id", "name", "description").where("description is not null")
    named = linking.parse_recordings(b.withColumn("path", F.concat(F.regexp_replace("name", "/", "／"), F.lit(".ts")))).where("error is null")
    told = named.select("broadcast_id", headers()("work_title", "description").alias("h")).where("h.episode_number is not null or h.episode_label is not null or h.error is not null")
    return told.select("broadcast_id", "h.*")


def n01_text_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of every episode title."""
    e = table(spark, folder, "episodes", "id", "title").where("title is not null")
    keys = {"normal": T.normalise, "search": T.search_key, "subtitle_key": T.subtitle_key, "identity": T.identity_key, "scoring": T.scoring_key}
    return e.select("id", *[T.column(f)("title").alias(k) for k, f in keys.items()])


def r01_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every recording's path linked to the catalogue, with confidence, reasons and target."""
    files = table(spark, folder, "recording_metadata", "meta_id", "path").select(F.col("meta_id").alias("rec"), "path")
    return linking.link(files, table(spark, folder, "works"), table(spark, folder, "episodes"), programs(spark, folder, "tid", "count", "channel_id", "subtitle", "deleted", "warn", "t"))


def r03_schedule_proof(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings whose episode the schedule of the day proves."""
    files = table(spark, folder, "recording_metadata", "meta_id", "path").select(F.col("meta_id").alias("rec"), "path")
    w, e = linking.catalogue_keys(table(spark, folder, "works"), table(spark, folder, "episodes"))
    records = linking.parse_recordings(files).where("error is null")
    pairs = linking.candidate_works(records, w)
    return linking.schedule_proof(records, w, pairs, e, programs(spark, folder, "tid", "count", "channel_id", "subtitle", "deleted", "warn", "t")).select("rec", "episode_id", "work_id", "tier")


def k03_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions of the linked files."""
    return linking.sidecars(r01_links(spark, folder), table(spark, folder, "works"), table(spark, folder, "episodes"))


def a18_link_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How a run went: files by status."""
    return r01_links(spark, folder).groupBy("status").agg(F.count("*").alias("files"))


def queries() -> dict:
    return {q.__name__: q for q in (e01_parsed_names, e20_description_headers, n01_text_keys, r01_links, r03_schedule_proof, k03_sidecars, a18_link_summary)}
