"""More queries over the same tables, each with its SQL: lookups, caches, plans against what is there, finals, date proof."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import columns as C
from linkloom.operators import linking
from linkloom.operators import resolution as R
from linkloom.plans.catalogue import DAY_SQL, LABEL_SQL, NUMBER_SQL, PLAIN_SQL, PROGRAMS_SQL, WIDE_SQL, day, programs
from linkloom.sources import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""SELECT tid, {DAY_SQL} AS day, min(count) AS value, count(DISTINCT channel_id) AS witnesses FROM {PROGRAMS_SQL} WHERE count > 0 AND tid > 0 GROUP BY ALL
HAVING bool_and(coalesce(channel_id > 0, false) AND coalesce(length(trim(subtitle)) > 0, false)) AND count(DISTINCT channel_id) >= 2 AND count(DISTINCT count) = 1""")
def a04_told_alike(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which two channels or more tell one count of a work, whatever is doubtful about their rows."""
    p = programs(spark, folder, "tid", "count", "channel_id", "subtitle", "t").where("count > 0 and tid > 0").withColumn("day", day(F.col("t")))
    return R.corroborated(p, ["tid", "day"], "count", "channel_id", F.lit(True), "subtitle")


@query(f"""WITH e AS (SELECT id, work_id, sort_number, {NUMBER_SQL} AS n, {LABEL_SQL} AS label, coalesce(trim(translate(number_text, '{WIDE_SQL}', '{PLAIN_SQL}')), '') AS said FROM episodes),
c AS (SELECT * FROM e WHERE n IS NOT NULL AND (said = '' OR label IS NOT NULL)),
w AS (SELECT w.id AS work_id FROM works w JOIN (SELECT work_id, count(*) AS k FROM e GROUP BY work_id) l ON l.work_id = w.id WHERE w.episodes_count > 0 AND l.k >= w.episodes_count),
t AS (SELECT work_id, max(n) AS top, max(sort_number) AS top_sort, count(*) = count(DISTINCT n) AND max(n) - min(n) + 1 = count(*) AS whole FROM c GROUP BY work_id),
f AS (SELECT work_id, count(*) AS names, min(id) AS id, max(sort_number) AS sort FROM e WHERE said IN ('最終話', '最終回') GROUP BY work_id),
h AS (SELECT c.work_id, min(c.id) AS id FROM c JOIN t ON t.work_id = c.work_id AND t.top = c.n GROUP BY c.work_id HAVING count(*) = 1),
r AS (SELECT w.work_id, CASE WHEN coalesce(f.names, 0) = 0 THEN h.id WHEN f.names = 1 AND t.whole AND f.sort > t.top_sort THEN f.id END AS episode_id FROM w LEFT JOIN f ON f.work_id = w.work_id LEFT JOIN t ON t.work_id = w.work_id LEFT JOIN h ON h.work_id = w.work_id)
SELECT work_id, episode_id FROM r WHERE episode_id IS NOT NULL""")
def a07_last_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """The last episode of each complete list, as the linking has it."""
    w = linking.work_keys(table(spark, folder, "works"))
    return linking.episode_keys(w, table(spark, folder, "episodes")).where("final").select("work_id", "episode_id")


@query(f"""WITH x AS (SELECT tid || '/' || channel_id AS part, pid, count AS n, t FROM {PROGRAMS_SQL} WHERE NOT deleted AND count > 0 AND tid IS NOT NULL AND channel_id IS NOT NULL),
g AS (SELECT part FROM x GROUP BY part HAVING count(*) = count(DISTINCT t) AND min(t) > 0),
r AS (SELECT part, pid, n, row_number() OVER (PARTITION BY part ORDER BY t) AS o FROM x SEMI JOIN g USING (part)),
h AS (SELECT part FROM r GROUP BY part HAVING min(n - o) = max(n - o) AND min(n - o) > 0)
SELECT part, pid, n, CAST(o AS INTEGER) AS local FROM r SEMI JOIN h USING (part)""")
def a09_parts_that_count_on(spark: SparkSession, folder: str) -> DataFrame:
    """Local numbers of a work's rows on a channel that count on from an earlier part."""
    p = programs(spark, folder, "tid", "count", "channel_id", "deleted", "t").where("not deleted and count > 0 and tid is not null and channel_id is not null")
    return R.local_ordinals(p.select(F.concat_ws("/", "tid", "channel_id").alias("part"), "pid", F.col("count").alias("n"), "t"), "part", "t", "n", ["pid"])


@query(f"SELECT id, nullif(TRY_CAST(regexp_extract(translate(title, '{WIDE_SQL}', '{PLAIN_SQL}'), '[(]([0-9]{{4}})(年版)?[)]', 1) AS INTEGER), 0) AS year FROM works")
def e24_title_year(spark: SparkSession, folder: str) -> DataFrame:
    """The year that a work's title names."""
    return table(spark, folder, "works", "id", "title").select("id", C.title_year(F.col("title")).alias("year"))


@query("""WITH m AS (SELECT id, min(channel_id) AS channel_id, min(start_at) AS start_at FROM recordings WHERE id IS NOT NULL GROUP BY id), c AS (SELECT history_id, count(DISTINCT channel_id) AS n, min(channel_id) AS ch FROM schedule_channels WHERE history_id IS NOT NULL GROUP BY history_id)
SELECT m.id, CASE WHEN c.n = 1 THEN c.ch END AS channel, CASE WHEN c.n IS NULL THEN 'none' WHEN c.n = 1 THEN 'found' ELSE 'several' END AS status FROM m LEFT JOIN c ON c.history_id = m.channel_id WHERE m.channel_id IS NOT NULL""")
def s12_channel_of_recording(spark: SparkSession, folder: str) -> DataFrame:
    """The channel of each recording by the recorder's own id, where that is one."""
    r = table(spark, folder, "recordings", "id", "channel_id").where("id is not null").groupBy("id").agg(F.min("channel_id").alias("channel_id"))
    c = table(spark, folder, "schedule_channels", "history_id", "channel_id").distinct().select(F.col("history_id").alias("channel_id"), F.col("channel_id").alias("channel"))
    return r.join(R.exact_lookup(r, c, "channel_id", "channel"), "channel_id").select("id", "channel", "status")


@query("SELECT e.work_id AS id, CASE WHEN n = 1 THEN title END AS title, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'found' ELSE 'several' END AS status FROM (SELECT DISTINCT work_id FROM episodes WHERE work_id IS NOT NULL) e LEFT JOIN (SELECT id, count(*) AS n, min(title) AS title FROM works WHERE id IS NOT NULL GROUP BY id) w ON w.id = e.work_id")
def s08_work_by_exact_id(spark: SparkSession, folder: str) -> DataFrame:
    """The work of each id that episodes name: one, none or several."""
    return R.exact_lookup(table(spark, folder, "episodes", "work_id").withColumnRenamed("work_id", "id"), table(spark, folder, "works", "id", "title"), "id", "title")


@query(f"""SELECT w.id AS work_id, m.recorded_date AS day, count(*) AS programs FROM (SELECT DISTINCT work_title, recorded_date FROM recording_metadata WHERE work_title IS NOT NULL AND recorded_date IS NOT NULL) m JOIN works w ON w.title = m.work_title
JOIN {PROGRAMS_SQL} p ON p.tid = TRY_CAST(trim(w.syobocal_tid) AS INTEGER) AND p.t > (datediff('day', DATE '1970-01-01', m.recorded_date) - 1) * 86400000::BIGINT - 32400000 AND p.t < (datediff('day', DATE '1970-01-01', m.recorded_date) + 2) * 86400000::BIGINT - 32400000 GROUP BY ALL""")
def s07_programs_in_open_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a work that begin between the day before a recording and the second day after it, both ends excluded."""
    m = table(spark, folder, "recording_metadata", "work_title", "recorded_date").where("work_title is not null and recorded_date is not null").distinct()
    w = table(spark, folder, "works", "id", "title", "syobocal_tid").withColumn("tid", F.trim("syobocal_tid").try_cast("int"))
    asked = m.join(w, m["work_title"] == w["title"]).select(F.col("id").alias("work_id"), "tid", F.col("recorded_date").alias("day"))
    # each row meets the days around it by equality, then the interval itself
    start = F.unix_date("day").cast("long") * 86_400_000 - 9 * 3_600_000
    near = asked.withColumn("d", F.explode(F.sequence(F.unix_date("day").cast("long") - 1, F.unix_date("day").cast("long") + 2))).withColumn("start", start)
    p = programs(spark, folder, "tid", "t").withColumn("d", day(F.col("t")))
    hit = near.join(p, ["tid", "d"]).where((F.col("t") > F.col("start") - 86_400_000) & (F.col("t") < F.col("start") + 2 * 86_400_000))
    return hit.groupBy("work_id", "day").agg(F.count("*").alias("programs"))


@query("""WITH m AS (SELECT max(loaded_at) - INTERVAL 30 DAY AS cut FROM recordings), r AS (SELECT DISTINCT id, name, loaded_at FROM recordings WHERE id IS NOT NULL AND loaded_at IS NOT NULL)
SELECT id, arg_max(name, (loaded_at, CASE WHEN loaded_at > cut THEN 1 ELSE 0 END)) AS name, CAST(epoch_ms(max(loaded_at)) AS BIGINT) AS loaded_ms FROM r, m GROUP BY id""")
def k07_cache_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of the history, with the answers of the last thirty days laid over it."""
    r = table(spark, folder, "recordings", "id", "name", "loaded_at").distinct()
    cut = F.broadcast(r.agg((F.max("loaded_at") - F.expr("INTERVAL 30 DAYS")).alias("cut")))
    split = r.join(cut, F.lit(True))
    return R.refreshed(split.where("loaded_at <= cut").drop("cut"), split.where("loaded_at > cut").drop("cut"), "id", "loaded_at").select("id", "name", F.unix_millis(F.col("loaded_at").cast("timestamp")).alias("loaded_ms"))


TARGET_SQL = "work_title || ' #' || coalesce(CAST(nullif(greatest(episode_number, 0), 0) AS VARCHAR), '?')"


@query(f"""WITH m AS (SELECT meta_id, path, {TARGET_SQL} AS target, coalesce(final_episode, false) AS there FROM recording_metadata WHERE work_title IS NOT NULL),
x AS (SELECT target, count(*) AS k FROM m WHERE there GROUP BY target)
SELECT n.meta_id, n.target, CAST(row_number() OVER (PARTITION BY n.target ORDER BY n.path, n.meta_id) - 1 + coalesce(x.k, 0) AS INTEGER) AS copy FROM m n LEFT JOIN x ON x.target = n.target WHERE NOT n.there""")
def k02_free_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of copies behind those that stand at a target already (here: files of finals)."""
    m = table(spark, folder, "recording_metadata", "meta_id", "path", "work_title", "episode_number", "final_episode").where("work_title is not null")
    n = F.coalesce(F.when(F.col("episode_number") > 0, F.col("episode_number")).cast("string"), F.lit("?"))
    m = m.withColumn("target", F.concat("work_title", F.lit(" #"), n)).withColumn("there", F.coalesce("final_episode", F.lit(False)))
    return R.free_copies(m.where("not there"), m.where("there"), "target", ["path", "meta_id"], "meta_id")


@query("""WITH m AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, work_title, coalesce(final_episode, false) AS there FROM recording_metadata WHERE path IS NOT NULL AND work_title IS NOT NULL),
x AS (SELECT folder, min(work_title) AS lo, max(work_title) AS hi, CAST(count(DISTINCT work_title) AS INTEGER) AS others FROM m WHERE there GROUP BY folder)
SELECT DISTINCT m.folder, m.work_title, x.others FROM m JOIN x ON x.folder = m.folder WHERE NOT m.there AND (x.lo <> m.work_title OR x.hi <> m.work_title)""")
def s26_identity_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Folders that already belong to another work than one that is to be written there."""
    m = table(spark, folder, "recording_metadata", "path", "work_title", "final_episode").where("path is not null").withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("there", F.coalesce("final_episode", F.lit(False)))
    return R.conflicting(m.where("not there"), m.where("there"), "folder", "work_title")


@query(f"""WITH e AS (SELECT id, work_id, {NUMBER_SQL} AS n FROM episodes),
u AS (SELECT work_id, n, min(id) AS id FROM e WHERE n IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
w AS (SELECT id AS work_id, title, CASE WHEN TRY_CAST(trim(syobocal_tid) AS INTEGER) > 0 THEN TRY_CAST(trim(syobocal_tid) AS INTEGER) END AS tid FROM works),
s AS (SELECT tid, {DAY_SQL} AS day, count(DISTINCT count) AS kinds, min(count) AS n FROM {PROGRAMS_SQL} WHERE NOT deleted AND NOT warn AND count > 0 GROUP BY ALL),
a AS (SELECT m.meta_id AS rec, nullif(greatest(m.episode_number, 0), 0) AS asked, w.work_id, w.tid, s.kinds, CASE WHEN s.kinds = 1 THEN s.n END AS n, u.id AS episode_id
FROM recording_metadata m JOIN w ON w.title = m.work_title LEFT JOIN s ON s.tid = w.tid AND s.day = datediff('day', DATE '1970-01-01', m.recorded_date) LEFT JOIN u ON u.work_id = w.work_id AND s.kinds = 1 AND u.n = s.n WHERE m.recorded_date IS NOT NULL),
r AS (SELECT rec, count(*) FILTER (WHERE episode_id IS NOT NULL AND (asked IS NULL OR asked = n)) AS good, count(*) FILTER (WHERE episode_id IS NULL AND (tid IS NULL OR kinds IS NOT NULL)) AS bad, min(episode_id) FILTER (WHERE episode_id IS NOT NULL AND (asked IS NULL OR asked = n)) AS episode_id FROM a GROUP BY rec)
SELECT rec, episode_id FROM r WHERE good = 1 AND bad = 0""")
def r03_proof_of_exact_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose exact title has works of which the schedule of the day proves one episode, and leaves no other open."""
    m = table(spark, folder, "recording_metadata", "meta_id", "work_title", "episode_number", "recorded_date").where("recorded_date is not null")
    records = m.select(F.col("meta_id").alias("rec"), "work_title", F.when(F.col("episode_number") > 0, F.col("episode_number")).alias("episode_number"), "recorded_date", F.lit(None).cast("string").alias("subtitle"))
    w = linking.work_keys(table(spark, folder, "works"))
    e = table(spark, folder, "episodes", "id", "work_id", "number", "number_text", "sort_number").select(F.col("id").alias("episode_id"), "work_id", C.episode_number(F.col("number"), F.col("number_text"), F.col("sort_number")).alias("n"), F.lit(None).cast("string").alias("episode_title"))
    pairs = records.join(w, records["work_title"] == w["title"]).select("rec", "work_id")
    return linking.schedule_proof(records, w, pairs, e, programs(spark, folder, "tid", "count", "deleted", "warn", "t")).select("rec", "episode_id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
