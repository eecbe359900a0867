"""Snapshot tables: one parquet file or folder per entity, read with column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The snapshot ``name`` of ``folder``; with ``columns``, only those (so that the scan reads no others)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, order: str | None = "loaded_at") -> DataFrame:
    """One row for each ``key``: the one delivered last, by ``order``.

    Rows without a key are dropped, as nothing can name them. A redelivered row differs only in ``order``; where more
    differs, the last delivery holds, and among deliveries of one moment the greatest row by its other columns, so the
    result never depends on the order of the input. The aggregate is partial on the map side: a key delivered a million
    times shuffles one row for each map task.
    """
    df = df.where(F.col(key).isNotNull())
    rest = [c for c in df.columns if c not in (key, order)]
    # maps can't be compared, so they travel beside the order, not in it
    by = [c for c in rest if not dict(df.dtypes)[c].startswith("map")]
    head = [F.col(order).alias("__order")] if order else []
    ranked = F.struct(*head, *[F.col(c) for c in by])
    picked = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), ranked).alias("__row"))
    return picked.select(key, *[F.col("__row")[c].alias(c) for c in rest])
