"""Recording files, their folders and sidecars as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of recordings.
EXTENSIONS = (".mp4", ".ts", ".mkv", ".m4v", ".m2ts")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def is_recording(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def is_transport_stream(path: Column) -> Column:
    return extension(path).isin(".ts", ".m2ts")


def recordings(spark: SparkSession, target: str, recursive: bool = False, skip: str = "backup") -> DataFrame:
    """(path, length) of the recordings in a folder, in the order of their paths; no contents are read.

    Folders named ``skip`` and links are left out, so that a rerun sees the same files. An explicit link is refused.
    """
    if os.path.islink(target):
        raise ValueError("the target is a link")

    def walk(folder: str) -> Iterator[tuple[str, int]]:
        with os.scandir(folder) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if recursive and e.name != skip:
                        yield from walk(e.path)
                elif e.is_file() and os.path.splitext(e.name)[1].lower() in EXTENSIONS:
                    yield e.path, e.stat().st_size

    if os.path.isfile(target):
        rows = [(target, os.path.getsize(target))] if os.path.splitext(target)[1].lower() in EXTENSIONS else []
    else:
        rows = list(walk(target))
    return spark.createDataFrame(rows, "path string, length long")


def recordings_in_store(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the recordings below a folder of any file system that Spark reads, listed by its executors' API."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(is_recording(F.col("path")))


def folder_works(files: DataFrame) -> DataFrame:
    """(folder, work_id, works): one job a folder of files(path, work_id): its work if it has just one; duplicates belong to the folder above."""
    folder = F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/duplicate$", "")
    g = files.where("work_id is not null").groupBy(folder.alias("folder")).agg(F.countDistinct("work_id").alias("works"), F.min("work_id").alias("w"))
    return g.select("folder", F.when(F.col("works") == 1, F.col("w")).alias("work_id"), "works")


def sidecar_identity(texts: DataFrame, id_type: str) -> DataFrame:
    """(folder, work_id, ids) of sidecars(folder, nfo, json): the id that all of a folder's sidecars name, null where they differ.

    nfo is XML with <uniqueid type="...">, json is {"work_id": n}; either may be missing.
    """
    xml = F.expr(f"try_cast(xpath_string(nfo, '//uniqueid[@type=\"{id_type}\"]/text()') as int)")
    both = texts.select("folder", F.explode(F.array(F.when(F.col("nfo").isNotNull(), xml), F.get_json_object("json", "$.work_id").try_cast("int"))).alias("id")).where("id > 0")
    g = both.groupBy("folder").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("w"))
    return g.select("folder", F.when(F.col("ids") == 1, F.col("w")).alias("work_id"), "ids")
