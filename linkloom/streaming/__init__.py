"""An extension beyond one-shot runs: names that arrive in a folder are parsed and linked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions.names import parsed
from linkloom.operators.linking import LinkOptions, link


def arriving(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Files named in JSON lines (path, seen_at) that land in ``folder``, each once within the watermark, with the fields of their names."""
    lines = spark.readStream.schema("path string, seen_at timestamp").json(folder)
    once = lines.where("path is not null").withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["path"])
    return once.withColumn("__p", parsed()("path")).select("path", "seen_at", "__p.*")


def link_arriving(stream: DataFrame, works: DataFrame, episodes: DataFrame, programs: DataFrame, out: str, checkpoint: str, options: LinkOptions = LinkOptions()) -> StreamingQuery:
    """Each batch of ``arriving`` linked against the snapshots and written under its own number, so that a batch that is run again replaces itself.

    Copies of one target are numbered on from what earlier batches have written.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = batch.select(F.sha2("path", 256).alias("rec"), "path")
        spark = batch.sparkSession
        schema = "rec string, path string, status string, strategy string, work_id int, episode_id int, confidence int, reasons array<string>, target string, batch long"
        there = spark.read.schema(schema).option("basePath", out).parquet(out).where(F.col("batch") < number) if number else None
        link(files, works, episodes, programs, options, taken=there).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
