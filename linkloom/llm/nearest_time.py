"""Matching records by nearest time: DuckDB ASOF joins inside bounded Arrow groups.

Both sides are cut into (key, time bucket) groups and hash-partitioned on them, so that one key with a third of all rows
is spread over as many groups as it has buckets. A right row is sent to every bucket in which a left row within the
tolerance may lie (one or two, as buckets are longer than that). Buckets that hold more left rows than ``max_group`` are salted: their left rows are dealt
out, their right rows repeated for each salt. Inside a task, groups are taken in the order of time in chunks of bounded size;
a chunk leaves to the next only its last right row and the left rows behind it, so that memory depends on the chunk and on
``max_group``, however many right rows a group has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 200_000
#: Hot groups that are broadcast; more of them are joined.
MAX_HOT = 10_000


def _asof(connection, right: pa.Table, left: pa.Table, tolerance: int) -> pa.Table:
    """Backward and forward ASOF joins in each group, then the nearer candidate within the tolerance."""
    connection.register("rights", right)
    connection.register("lefts", left)
    sql = f"""
    WITH r AS (SELECT g, t, min(id) AS id FROM rights GROUP BY g, t),
    l AS (SELECT g, t, id, row_number() OVER () AS n FROM lefts),
    c AS (
      SELECT l.n, l.id AS left_id, r.id AS right_id, l.t - r.t AS d, 0 AS later FROM l ASOF JOIN r ON l.g = r.g AND l.t >= r.t
      UNION ALL
      SELECT l.n, l.id, r.id, r.t - l.t, 1 FROM l ASOF JOIN r ON l.g = r.g AND l.t <= r.t)
    SELECT left_id, arg_min(right_id, (d, later)) AS right_id, min(d) AS distance FROM c WHERE d <= {int(tolerance)} GROUP BY n, left_id
    """
    out = connection.sql(sql).to_arrow_table()
    connection.unregister("rights")
    connection.unregister("lefts")
    return out


def _chunks(batches: Iterator[pa.RecordBatch], tolerance: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Groups in the order of time, in chunks: what a chunk leaves open goes over into the next.

    Of the group that a chunk ends in, the left rows behind its last right row may have a nearer one yet; they stay, with
    the right row before them (the smallest id of that moment). All others are settled.
    """
    import duckdb
    import numpy as np
    import pyarrow.compute as pc

    connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("distance", pa.int64())])
    held: list[pa.RecordBatch] = []
    n = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        if not n:
            return
        whole = pa.Table.from_batches(held)
        is_left = whole.column("side").to_numpy() == 1
        now = is_left
        keep = np.zeros(len(is_left), dtype=bool)
        if not last:
            own = pc.equal(whole.column("g"), whole.column("g")[whole.num_rows - 1]).to_numpy()
            rights = np.flatnonzero(own & ~is_left)
            behind = own & is_left
            if len(rights):
                behind[: rights[-1]] = False
                # rows of one moment lie in the order of their ids
                t = whole.column("t").to_numpy()
                keep[rights[np.searchsorted(t[rights], t[rights[-1]])]] = True
            now = is_left & ~behind
            keep |= behind
        if now.any() and not is_left.all():
            yield from _asof(connection, whole.filter(pa.array(~is_left)), whole.filter(pa.array(now)), tolerance).cast(schema).to_batches()
        held = [] if last else whole.filter(pa.array(keep)).to_batches()
        n = 0

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from flush(False)
    n += sum(b.num_rows for b in held)
    yield from flush(True)


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_ms: int, bucket_ms: int = 3_600_000, max_group: int = 100_000, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The nearest right row of the same key for each left row: left_id, right_id, distance (milliseconds, 0 or more).

    Both sides: key (any type that casts to STRING), id BIGINT, time_ms BIGINT; other columns are ignored. Rows with a
    null in any of the three have no partner and give no row; the same holds for left rows without a right row within the
    tolerance (inclusive). Of two right rows at the same distance the earlier holds, of several at one time the smallest
    id. Left rows may share a right row. Repeated left rows give repeated results. Empty tables give an empty result.
    """
    if bucket_ms <= 0 or tolerance_ms < 0:
        raise ValueError("the bucket must be positive, the tolerance not negative")
    bucket_ms = max(bucket_ms, tolerance_ms + 1)

    def side(df: DataFrame) -> DataFrame:
        cols = [F.col("key").cast("string").alias("k"), F.col("id").cast("long").alias("id"), F.col("time_ms").cast("long").alias("t")]
        return df.select(*cols).where(F.col("k").isNotNull() & F.col("id").isNotNull() & F.col("t").isNotNull())

    bucket = lambda c: F.floor(c / F.lit(bucket_ms)).cast("long")
    lf = side(left).withColumn("b", bucket(F.col("t")))
    rt = side(right).withColumn("b", F.explode(F.sequence(bucket(F.col("t") - tolerance_ms), bucket(F.col("t") + tolerance_ms))))
    hot = lf.groupBy("k", "b").count().where(F.col("count") > max_group)
    hot = hot.select("k", "b", F.ceil(F.col("count") / max_group).cast("int").alias("salts"))
    # hot groups are few, mostly none: measured first, so that both sides need no shuffle for them
    found = hot.limit(MAX_HOT + 1).collect()
    if len(found) <= MAX_HOT:
        hot = F.broadcast(lf.sparkSession.createDataFrame(found, hot.schema))
    if found:
        lf, rt = lf.join(hot, ["k", "b"], "left"), rt.join(hot, ["k", "b"], "left")
        salts = F.coalesce(F.col("salts"), F.lit(1))
        lf = lf.withColumn("s", F.pmod(F.xxhash64("id", "t"), salts).cast("int"))
        rt = rt.withColumn("s", F.explode(F.sequence(F.lit(0), salts - 1)))
    else:
        lf, rt = lf.withColumn("s", F.lit(0)), rt.withColumn("s", F.lit(0))
    group = F.concat_ws("\u0001", F.col("s"), F.col("b"), F.col("k")).alias("g")
    both = rt.select(group, F.lit(0).alias("side"), "t", "id").unionByName(lf.select(group, F.lit(1).alias("side"), "t", "id"))
    dealt = both.repartition("g").sortWithinPartitions("g", "t", "side", "id")
    return dealt.mapInArrow(lambda it: _chunks(it, tolerance_ms, chunk_rows), "left_id bigint, right_id bigint, distance bigint")
