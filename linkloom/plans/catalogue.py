"""Queries of relational shapes over the catalogue, the schedule and the history, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import columns as C
from linkloom.operators import resolution as R
from linkloom.sources import latest, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
JST_MS = 9 * 3_600_000
DAY_MS = 86_400_000

WIDE_SQL = C.WIDE_ASCII.replace("'", "''")
PLAIN_SQL = C.PLAIN_ASCII.replace("'", "''")
# the latest delivery of each row of the schedule; redelivered rows differ in loaded_at alone
PROGRAMS_SQL = "(SELECT DISTINCT pid, tid, channel_id, count, started_at, ended_at, subtitle, deleted, warn, CAST(epoch_ms(started_at) AS BIGINT) AS t FROM schedule_programs WHERE pid IS NOT NULL)"
HISTORY_SQL = "(SELECT DISTINCT id, channel_id, start_at, end_at, name FROM recordings WHERE id IS NOT NULL)"


def key_sql(x: str) -> str:
    return f"lower(replace(translate({x}, '{WIDE_SQL}', '{PLAIN_SQL}'), ' ', ''))"


def title_key_sql(x: str) -> str:
    return f"regexp_replace({key_sql(x)}, '[\\-.・/:;,_~〜()\\[\\]「」『』【】<>]', '', 'g')"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def programs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The schedule, redelivered rows once, with the start as milliseconds (t)."""
    df = table(spark, folder, "schedule_programs")
    wanted = [c for c in columns if c not in ("pid", "t")]
    need = {*wanted, *(["started_at"] if "t" in columns else [])}
    out = latest(df.select("pid", *sorted(need), "loaded_at"), "pid")
    if "t" in columns:
        out = out.withColumn("t", F.unix_millis(F.col("started_at").cast("timestamp")))
    return out.select("pid", *columns)


def day(c):
    return F.floor((c + F.lit(JST_MS)) / F.lit(DAY_MS)).cast("long")


DAY_SQL = f"CAST(floor((t + {JST_MS}) / {DAY_MS}.0) AS BIGINT)"


# ---- aggregates ---------------------------------------------------------------------------------------------------------


@query("SELECT title, CASE WHEN count(*) = 1 THEN min(id) END AS value, count(*) AS candidates FROM works GROUP BY title")
def a01_unique_or_null(spark, folder):
    """The one work of a title, or none."""
    return R.unique_or_null(table(spark, folder, "works", "id", "title"), ["title"], "id")


@query(f"""SELECT tid, {DAY_SQL} AS day, count(*) AS usable, count(DISTINCT count) AS kinds, CASE WHEN count(DISTINCT count) = 1 THEN min(count) END AS value
FROM {PROGRAMS_SQL} WHERE NOT deleted AND NOT warn AND count > 0 GROUP BY ALL""")
def a02_unanimous_day(spark, folder):
    """The episode count on which all clean rows of a work and day agree."""
    p = programs(spark, folder, "tid", "count", "deleted", "warn", "t").withColumn("day", day(F.col("t")))
    return R.unanimous(p, ["tid", "day"], "count", ~F.col("deleted") & ~F.col("warn") & (F.col("count") > 0))


@query("""SELECT tier_owner AS work_id, CASE WHEN n1 = 1 THEN v1 WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN v2 WHEN n3 = 1 THEN v3 END AS value,
CASE WHEN n1 = 1 THEN 'label' WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN 'number' WHEN n3 = 1 THEN 'sort' END AS tier,
CASE WHEN n1 = 1 THEN 'unique' WHEN n1 > 1 THEN 'ambiguous label' WHEN n2 = 1 THEN 'unique' WHEN n3 = 1 THEN 'unique' ELSE CASE WHEN n3 > 1 THEN 'ambiguous sort' ELSE 'no candidate' END END AS reason
FROM (SELECT work_id AS tier_owner, count(*) FILTER (number_text = '第1話') AS n1, min(id) FILTER (number_text = '第1話') AS v1, count(*) FILTER (number = 1) AS n2, min(id) FILTER (number = 1) AS v2,
count(*) FILTER (sort_number = 10) AS n3, min(id) FILTER (sort_number = 10) AS v3 FROM episodes WHERE number_text = '第1話' OR number = 1 OR sort_number = 10 GROUP BY 1)""")
def a03_priority_tiers(spark, folder):
    """The first episode of a work by label, else number, else sort key; two labels veto, two numbers do not."""
    e = table(spark, folder, "episodes", "id", "work_id", "number", "number_text", "sort_number")
    tiers = F.array_compact(F.array(F.when(F.col("number_text") == "第1話", "label"), F.when(F.col("number") == 1, "number"), F.when(F.col("sort_number") == 10, "sort")))
    rows = e.select("id", "work_id", F.explode(tiers).alias("t"))
    return R.priority_tiers(rows, ["work_id"], "t", "id", [("label", True), ("number", False), ("sort", True)])


@query(f"""SELECT tid, {DAY_SQL} AS day, min(count) AS value, count(DISTINCT channel_id) AS witnesses FROM {PROGRAMS_SQL} GROUP BY ALL
HAVING bool_and(coalesce(warn, false)) AND bool_and(coalesce(channel_id > 0, false) AND coalesce(length(trim(subtitle)) > 0, false)) AND count(DISTINCT channel_id) >= 2 AND count(DISTINCT count) = 1 AND count(*) = count(count)""")
def a04_corroborated(spark, folder):
    """Doubtful rows alone, but two channels tell the same count."""
    p = programs(spark, folder, "tid", "count", "channel_id", "subtitle", "warn", "t").withColumn("day", day(F.col("t")))
    return R.corroborated(p, ["tid", "day"], "count", "channel_id", F.col("warn"), "subtitle")


@query(f"""WITH f AS (SELECT tid, {DAY_SQL} AS day, count, arg_min(channel_id, (t, pid)) AS w FROM {PROGRAMS_SQL} WHERE count > 0 AND channel_id IS NOT NULL GROUP BY ALL)
SELECT tid, count(*) AS marks, min(w) AS witness FROM f GROUP BY tid HAVING count(*) >= 2 AND count(DISTINCT w) = 1""")
def a05_batch_anchor(spark, folder):
    """Works of which two (day, count) marks come from one and the same channel."""
    p = programs(spark, folder, "tid", "count", "channel_id", "t").where("count > 0").withColumn("day", day(F.col("t")))
    return R.anchors(p, "tid", ["day", "count"], "channel_id", ["t", "pid"])


@query(f"""SELECT tid, {DAY_SQL} AS day, count, CASE WHEN count(DISTINCT channel_id) = 1 THEN min(channel_id) END AS value, count(DISTINCT channel_id) AS candidates
FROM {PROGRAMS_SQL} WHERE count > 0 AND NOT deleted GROUP BY ALL""")
def a06_anchor_channel(spark, folder):
    """The one channel that airs an episode on a day."""
    p = programs(spark, folder, "tid", "count", "channel_id", "deleted", "t").where("count > 0 and not deleted").withColumn("day", day(F.col("t")))
    return R.unique_or_null(p, ["tid", "day", "count"], "channel_id", distinct=True)


@query("""SELECT work_id, CASE WHEN count(*) = count(DISTINCT number) AND max(number) - min(number) + 1 = count(DISTINCT number) THEN max(number) END AS final, count(*) AS members
FROM episodes WHERE number IS NOT NULL GROUP BY work_id""")
def a07_final_number(spark, folder):
    """The last number of a work whose numbers have no gap."""
    return R.final_number(table(spark, folder, "episodes", "work_id", "number"), "work_id", "number")


@query("""WITH g AS (SELECT work_id FROM episodes GROUP BY work_id HAVING count(*) = count(DISTINCT sort_number) AND min(coalesce(sort_number, 0)) > 0)
SELECT work_id, id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY sort_number) AS INTEGER) AS ordinal FROM episodes SEMI JOIN g USING (work_id)""")
def a08_ordinals(spark, folder):
    """The place of an episode in its work's list."""
    return R.ordinals(table(spark, folder, "episodes", "id", "work_id", "sort_number"), "work_id", "sort_number", ["id"])


LABEL_SQL = f"CASE WHEN regexp_full_match({key_sql('number_text')}, '第?[0-9]{{1,9}}(話|回|幕|夜|局|羽)|[#♯][0-9]{{1,9}}|ep(isode)?\\.?[0-9]{{1,9}}|[0-9]{{1,9}}') THEN nullif(CAST(regexp_extract({key_sql('number_text')}, '[0-9]+') AS INTEGER), 0) END"


@query(f"""WITH e AS (SELECT id, work_id, sort_number, {LABEL_SQL} AS n FROM episodes),
g AS (SELECT work_id FROM e GROUP BY work_id HAVING count(*) = count(DISTINCT sort_number) AND min(coalesce(sort_number, 0)) > 0),
r AS (SELECT work_id, id, n, row_number() OVER (PARTITION BY work_id ORDER BY sort_number) AS o FROM e SEMI JOIN g USING (work_id)),
h AS (SELECT work_id FROM r GROUP BY work_id HAVING count(*) = count(n) AND min(n - o) = max(n - o) AND min(n - o) > 0)
SELECT work_id, id, n, CAST(o AS INTEGER) AS local FROM r SEMI JOIN h USING (work_id)""")
def a09_local_ordinals(spark, folder):
    """Local numbers of works that count on from an earlier season."""
    e = table(spark, folder, "episodes", "id", "work_id", "number_text", "sort_number").select("id", "work_id", "sort_number", C.label_number(F.col("number_text")).alias("n"))
    return R.local_ordinals(e, "work_id", "sort_number", "n", ["id"])


SEASON_TAIL = "( ?(第[0-9]期|Season [0-9]|[0-9](nd|rd) Season|II|III))$"


@query(f"""WITH x AS (SELECT regexp_replace(w.title, '{SEASON_TAIL}', '') AS family, w.id AS member, e.sort_number FROM works w JOIN episodes e ON e.work_id = w.id WHERE w.title IS NOT NULL),
s AS (SELECT family, member, count(*) AS size, max(sort_number) AS top FROM x GROUP BY ALL)
SELECT family, member, size, top FROM s QUALIFY row_number() OVER (PARTITION BY family ORDER BY size DESC, member) = 1""")
def a10_longest_list(spark, folder):
    """Of a family of works the one with the longest list."""
    w = table(spark, folder, "works", "id", "title").where("title is not null").select(F.col("id").alias("member"), F.regexp_replace("title", SEASON_TAIL, "").alias("family"))
    e = table(spark, folder, "episodes", "work_id", "sort_number").withColumnRenamed("work_id", "member")
    return R.longest_list(w.join(e, "member").withColumn("o", F.col("member")), "family", "member", "sort_number", "o")


@query(f"""WITH x AS (SELECT regexp_replace(w.title, '{SEASON_TAIL}', '') AS family, e.number FROM works w JOIN episodes e ON e.work_id = w.id WHERE w.title IS NOT NULL AND e.number IS NOT NULL)
SELECT family, count(*) AS numbers, count(*) = count(DISTINCT number) AS disjoint FROM x GROUP BY family""")
def a11_disjoint_union(spark, folder):
    """Whether the lists of a family of works can be read as one."""
    w = table(spark, folder, "works", "id", "title").where("title is not null").select(F.col("id").alias("work_id"), F.regexp_replace("title", SEASON_TAIL, "").alias("family"))
    return R.disjoint(w.join(table(spark, folder, "episodes", "work_id", "number"), "work_id"), "family", "number")


@query("""SELECT work_id, count(*) AS rows, count(DISTINCT e.id) AS keys, count(*) = count(DISTINCT e.id) AND count(*) >= any_value(w.episodes_count) AND any_value(w.episodes_count) > 0 AS whole
FROM episodes e JOIN works w ON w.id = e.work_id GROUP BY work_id""")
def a12_list_integrity(spark, folder):
    """Whether a work's list is whole: ids unique, and as many as declared."""
    w = table(spark, folder, "works", "id", "episodes_count").withColumnRenamed("id", "work_id")
    g = table(spark, folder, "episodes", "id", "work_id").join(w, "work_id").groupBy("work_id").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("keys"), F.max("episodes_count").alias("d"))
    return g.select("work_id", "rows", "keys", ((F.col("rows") == F.col("keys")) & (F.col("rows") >= F.col("d")) & (F.col("d") > 0)).alias("whole"))


@query("SELECT count(*) AS rows, count(DISTINCT id) AS keys, count(*) = count(DISTINCT id) AND count(DISTINCT n) = 1 AND count(*) = max(n) AS whole FROM (SELECT id, (SELECT count(DISTINCT id) FROM recordings) AS n FROM recordings)")
def a12_page_integrity(spark, folder):
    """Whether the history, delivered in pages, is whole."""
    r = table(spark, folder, "recordings", "id")
    return R.page_integrity(r.crossJoin(F.broadcast(r.agg(F.countDistinct("id").alias("n")))), "id", F.col("n"))


@query("SELECT id, arg_min(name, (loaded_at, name)) AS name FROM recordings WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id")
def a13_first_delivery(spark, folder):
    """One row an id: the first delivered."""
    r = table(spark, folder, "recordings", "id", "name", "loaded_at").where("id is not null and name is not null")
    return r.groupBy("id").agg(F.min_by("name", F.struct("loaded_at", "name")).alias("name"))


@query(f"""WITH u AS (SELECT tid, {DAY_SQL} AS day, count(DISTINCT count) AS k, min(count) AS v FROM {PROGRAMS_SQL} WHERE NOT deleted AND count > 0 GROUP BY ALL)
SELECT day, count(*) FILTER (k = 1 AND v = 1) AS resolved, 0 AS failed, CASE WHEN count(*) FILTER (k = 1 AND v = 1) = 1 THEN min(tid) FILTER (k = 1 AND v = 1) END AS value FROM u GROUP BY day""")
def a16_cross_group(spark, folder):
    """The one work whose first episode airs on a day."""
    p = programs(spark, folder, "tid", "count", "deleted", "t").withColumn("day", day(F.col("t")))
    u = R.unanimous(p, ["tid", "day"], "count", ~F.col("deleted") & (F.col("count") > 0)).withColumn("ok", F.coalesce(F.col("value") == 1, F.lit(False)))
    return R.cross_group(u, ["day"], F.col("ok"), F.lit(False), "tid").withColumn("failed", F.col("failed").cast("int"))


@query("""SELECT CASE WHEN is_recording THEN 'recording' WHEN is_encoding THEN 'encoding' WHEN len(video_files) = 0 THEN 'no file' ELSE 'ready' END AS status, count(*) AS rows, count(DISTINCT id) AS records FROM recordings GROUP BY 1""")
def a18_status_summary(spark, folder):
    r = table(spark, folder, "recordings", "id", "is_recording", "is_encoding", "video_files")
    status = F.when(F.col("is_recording"), "recording").when(F.col("is_encoding"), "encoding").when(F.size("video_files") == 0, "no file").otherwise("ready")
    return r.groupBy(status.alias("status")).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("records"))


# ---- joins --------------------------------------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT DISTINCT work_title AS exact, {title_key_sql('work_title')} AS k FROM recording_metadata WHERE work_title IS NOT NULL), r AS (SELECT id, title AS rx, {title_key_sql('title')} AS rk FROM works WHERE title IS NOT NULL),
one AS (SELECT exact AS id, r.id AS right_id, 'exact' AS tier FROM l JOIN r ON exact = rx WHERE exact <> ''),
two AS (SELECT exact AS id, r.id AS right_id, 'key' AS tier FROM l JOIN r ON k = rk WHERE k <> '' AND exact NOT IN (SELECT id FROM one)),
three AS (SELECT exact AS id, r.id AS right_id, 'contains' AS tier FROM l JOIN r ON k <> '' AND rk <> '' AND (contains(k, rk) OR contains(rk, k)) WHERE exact NOT IN (SELECT id FROM one UNION ALL SELECT id FROM two))
SELECT DISTINCT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)""")
def j01_tiered_titles(spark, folder):
    """Titles of recordings to works: exactly, by key, by containment."""
    left = table(spark, folder, "recording_metadata", "work_title").where("work_title is not null").distinct().select(F.col("work_title").alias("id"), F.col("work_title").alias("exact"), C.title_key(F.col("work_title")).alias("k"))
    right = table(spark, folder, "works", "id", "title").where("title is not null").select("id", F.col("title").alias("exact"), C.title_key(F.col("title")).alias("k"))
    return R.tiered_match(left, right)


@query(f"""SELECT p.pid, w.id AS work_id, w.id IS NOT NULL AS listed FROM {PROGRAMS_SQL} p LEFT JOIN (SELECT min(id) AS id, TRY_CAST(trim(syobocal_tid) AS INTEGER) AS tid FROM works WHERE TRY_CAST(trim(syobocal_tid) AS INTEGER) > 0 GROUP BY 2) w ON w.tid = p.tid""")
def j06_work_of_schedule(spark, folder):
    """Rows of the schedule and their works; an id that is no number is unknown, not a mismatch."""
    w = table(spark, folder, "works", "id", "syobocal_tid").select(F.col("id").alias("work_id"), F.trim("syobocal_tid").try_cast("int").alias("tid")).where("tid > 0").groupBy("tid").agg(F.min("work_id").alias("work_id"))
    return programs(spark, folder, "tid").join(w, "tid", "left").select("pid", "work_id", F.col("work_id").isNotNull().alias("listed"))


NUMBER_SQL = f"""CASE WHEN regexp_full_match({key_sql('number_text')}, '(第|[#♯]|ep(isode)?\\.?)?[0-9]{{1,6}}[.][0-9]{{1,6}}話?') AND NOT regexp_full_match({key_sql('number_text')}, '.*[.]0+話?') OR number <> floor(number) THEN NULL
WHEN number IS NOT NULL THEN coalesce(CASE WHEN number > 0 THEN CAST(number AS INTEGER) END, {LABEL_SQL})
WHEN number_text IS NOT NULL AND trim(translate(number_text, '　', ' ')) <> '' THEN {LABEL_SQL} WHEN sort_number > 0 THEN sort_number END"""


@query(f"""WITH e AS (SELECT id, work_id, {NUMBER_SQL} AS n FROM episodes),
w AS (SELECT min(id) AS work_id, TRY_CAST(trim(syobocal_tid) AS INTEGER) AS tid FROM works WHERE TRY_CAST(trim(syobocal_tid) AS INTEGER) > 0 GROUP BY 2),
x AS (SELECT p.pid, e.id FROM {PROGRAMS_SQL} p JOIN w ON w.tid = p.tid JOIN e ON e.work_id = w.work_id AND e.n = p.count WHERE p.count > 0)
SELECT pid, CASE WHEN count(*) = 1 THEN min(id) END AS value, count(*) AS candidates FROM x GROUP BY pid""")
def j07_episode_of_schedule(spark, folder):
    """The one episode that a row's count names."""
    e = table(spark, folder, "episodes", "id", "work_id", "number", "number_text", "sort_number")
    e = e.select(F.col("id").alias("episode_id"), "work_id", C.episode_number(F.col("number"), F.col("number_text"), F.col("sort_number")).alias("count"))
    w = table(spark, folder, "works", "id", "syobocal_tid").select(F.col("id").alias("work_id"), F.trim("syobocal_tid").try_cast("int").alias("tid")).where("tid > 0").groupBy("tid").agg(F.min("work_id").alias("work_id"))
    rows = programs(spark, folder, "tid", "count").where("count > 0").join(w, "tid").join(e, ["work_id", "count"])
    return R.unique_or_null(rows, ["pid"], "episode_id")


@query(f"SELECT r.id AS recording_id, p.pid FROM {HISTORY_SQL} r JOIN (SELECT DISTINCT channel_id, history_id FROM schedule_channels) c ON c.history_id = r.channel_id JOIN {PROGRAMS_SQL} p ON p.channel_id = c.channel_id AND floor((p.t + {JST_MS}) / {DAY_MS}.0) = floor((r.start_at + {JST_MS}) / {DAY_MS}.0) AND p.t > r.start_at - 600000 AND p.t < r.start_at + 600000 WHERE NOT p.deleted")
def j08_same_day_window(spark, folder):
    """Recordings and rows of the schedule on one channel and day within an open window: a range beside equal keys."""
    c = table(spark, folder, "schedule_channels", "channel_id", "history_id").distinct()
    r = latest(table(spark, folder, "recordings", "id", "channel_id", "start_at", "loaded_at"), "id").withColumnRenamed("channel_id", "history_id").join(c, "history_id").withColumn("day", day(F.col("start_at")))
    p = programs(spark, folder, "channel_id", "deleted", "t").where("not deleted").withColumn("day", day(F.col("t")))
    return r.join(p, ["channel_id", "day"]).where("t > start_at - 600000 and t < start_at + 600000").select(F.col("id").alias("recording_id"), "pid")


@query(f"""SELECT b.broadcast_id, p.pid FROM (SELECT DISTINCT broadcast_id, {key_sql('channel')} AS k, started_at, ended_at FROM broadcasts) b
JOIN (SELECT {key_sql('name')} AS k, min(channel_id) AS channel_id FROM schedule_channels GROUP BY 1 HAVING count(*) = 1) c ON c.k = b.k
JOIN {PROGRAMS_SQL} p ON p.channel_id = c.channel_id AND p.started_at = b.started_at AND p.ended_at = b.ended_at""")
def j09_exact_interval(spark, folder):
    """Embedded broadcasts to the schedule: channel by its name's key, start and end exactly."""
    b = table(spark, folder, "broadcasts", "broadcast_id", "channel", "started_at", "ended_at").select("broadcast_id", C.plain_key(F.col("channel")).alias("k"), "started_at", "ended_at").distinct()
    c = R.unique_or_null(table(spark, folder, "schedule_channels", "channel_id", "name").select("channel_id", C.plain_key(F.col("name")).alias("k")), ["k"], "channel_id").where("value is not null").select("k", F.col("value").alias("channel_id"))
    return b.join(c, "k").join(programs(spark, folder, "channel_id", "started_at", "ended_at"), ["channel_id", "started_at", "ended_at"]).select("broadcast_id", "pid")


@query(f"""SELECT c.channel_id, b.channel AS name FROM (SELECT {key_sql('channel')} AS k, min(channel) AS channel FROM (SELECT DISTINCT channel FROM broadcasts WHERE channel IS NOT NULL) GROUP BY 1 HAVING count(*) = 1) b
JOIN (SELECT {key_sql('name')} AS k, min(channel_id) AS channel_id FROM schedule_channels GROUP BY 1 HAVING count(*) = 1) c ON c.k = b.k""")
def j10_channels_one_to_one(spark, folder):
    """Channel names of two systems, where the keys are unique on both sides."""
    b = table(spark, folder, "broadcasts", "channel").where("channel is not null").distinct().select(F.col("channel").alias("name"), C.plain_key(F.col("channel")).alias("k"))
    c = table(spark, folder, "schedule_channels", "channel_id", F.col("name")).select("channel_id", C.plain_key(F.col("name")).alias("k"))
    return R.one_to_one(b, c, "k").select("channel_id", "name")


STEM_SQL = f"regexp_replace({key_sql('f')}, '\\.(mp4|ts|mkv|m4v|m2ts)$', '')"


@query(f"""WITH h AS (SELECT DISTINCT id, {STEM_SQL} AS stem FROM (SELECT id, unnest(video_files).filename AS f FROM recordings) WHERE regexp_matches({key_sql('f')}, '\\.(mp4|ts|mkv|m4v|m2ts)$')),
m AS (SELECT meta_id, {STEM_SQL} AS stem FROM (SELECT meta_id, regexp_extract(path, '[^/]*$') AS f FROM recording_metadata))
SELECT meta_id, CASE WHEN count(DISTINCT h.id) = 1 THEN min(h.id) END AS value, count(DISTINCT h.id) AS candidates FROM m JOIN h USING (stem) WHERE stem <> '' GROUP BY meta_id""")
def j11_file_of_history(spark, folder):
    """Files to the recordings that list them, by the stem of the name: one or none."""
    ext = "\\.(mp4|ts|mkv|m4v|m2ts)$"
    h = table(spark, folder, "recordings", "id", "video_files").select("id", F.explode("video_files").alias("v")).select("id", C.plain_key(F.col("v.filename")).alias("f")).where(F.col("f").rlike(ext))
    h = h.select("id", F.regexp_replace("f", ext, "").alias("stem")).distinct()
    m = table(spark, folder, "recording_metadata", "meta_id", "path").select("meta_id", F.regexp_replace(C.plain_key(F.regexp_extract("path", "[^/]*$", 0)), ext, "").alias("stem"))
    return R.unique_or_null(m.where("stem <> ''").join(h, "stem"), ["meta_id"], "id", distinct=True)


@query("SELECT work_id, coalesce(CASE work_title WHEN '臆病なマフラー Motif' THEN 'reviewed' WHEN '深いマント Jigsaw' THEN 'special' END, media) AS media FROM (SELECT id AS work_id, title AS work_title, media FROM works)")
def j13_override(spark, folder):
    """A fixed table of exceptions laid over the catalogue."""
    fixed = spark.createDataFrame([("臆病なマフラー Motif", "reviewed"), ("深いマント Jigsaw", "special")], "title string, media string")
    return R.override(table(spark, folder, "works", "id", "title", "media"), fixed, ["title"], ["media"]).select(F.col("id").alias("work_id"), "media")


@query(f"""SELECT meta_id, episode_number IS NOT NULL AND episode_number > 0 AND n IS NOT NULL AND episode_number <> n AS conflict, CASE WHEN NOT (episode_number > 0 AND n IS NOT NULL AND episode_number <> n) OR episode_number IS NULL OR n IS NULL OR episode_number <= 0 THEN coalesce(nullif(greatest(episode_number, 0), 0), n) END AS value
FROM (SELECT meta_id, episode_number, {LABEL_SQL.replace('number_text', 'episode_label')} AS n FROM recording_metadata)""")
def j16_agree_or_conflict(spark, folder):
    """The number of a file by its two tellings; zero is unknown."""
    m = table(spark, folder, "recording_metadata", "meta_id", "episode_number", "episode_label")
    value, clash = R.agree_or_conflict(F.when(F.col("episode_number") > 0, F.col("episode_number")), C.label_number(F.col("episode_label")))
    return m.select("meta_id", F.coalesce(clash, F.lit(False)).alias("conflict"), value.alias("value"))


@query(f"SELECT id, title FROM works w WHERE NOT EXISTS (SELECT 1 FROM {PROGRAMS_SQL} p WHERE p.tid = TRY_CAST(trim(w.syobocal_tid) AS INTEGER))")
def j18_never_aired(spark, folder):
    """Works without any row of the schedule."""
    w = table(spark, folder, "works", "id", "title", "syobocal_tid").withColumn("tid", F.trim("syobocal_tid").try_cast("int"))
    return w.join(table(spark, folder, "schedule_programs", "pid", "tid").where("pid is not null").select("tid").distinct(), "tid", "left_anti").select("id", "title")


@query(f"SELECT id, title FROM works w WHERE EXISTS (SELECT 1 FROM {PROGRAMS_SQL} p WHERE p.tid = TRY_CAST(trim(w.syobocal_tid) AS INTEGER) AND NOT p.deleted AND NOT p.warn AND p.count > 0)")
def j19_has_clean_rows(spark, folder):
    """Works with a usable row of the schedule."""
    w = table(spark, folder, "works", "id", "title", "syobocal_tid").withColumn("tid", F.trim("syobocal_tid").try_cast("int"))
    p = programs(spark, folder, "tid", "count", "deleted", "warn").where("not deleted and not warn and count > 0").select("tid").distinct()
    return w.join(p, "tid", "left_semi").select("id", "title")


# ---- windows, sets, predicates ------------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT tid, pid, t, (CASE WHEN count > 0 THEN 10 ELSE 0 END) + (CASE WHEN length(subtitle) > 0 THEN 10 ELSE 0 END) + (CASE WHEN NOT warn THEN 1 ELSE 0 END) AS score FROM {PROGRAMS_SQL} WHERE NOT deleted)
SELECT tid, score, pid FROM x QUALIFY row_number() OVER (PARTITION BY tid ORDER BY score DESC, t, pid) = 1 AND score >= 10""")
def w01_best_row(spark, folder):
    """The row of a work that tells most, the earliest of equal ones, if it tells enough."""
    p = programs(spark, folder, "tid", "count", "subtitle", "warn", "deleted", "t").where("not deleted")
    score = F.when(F.col("count") > 0, 10).otherwise(0) + F.when(F.length("subtitle") > 0, 10).otherwise(0) + F.when(~F.col("warn"), 1).otherwise(0)
    return R.top_one(p, "tid", score, ["t", "pid"], ["pid"], least=10)


@query(f"""SELECT meta_id, target, CAST(row_number() OVER (PARTITION BY target ORDER BY path, meta_id) - 1 AS INTEGER) AS copy FROM
(SELECT meta_id, path, work_title || ' #' || coalesce(CAST(nullif(greatest(episode_number, 0), 0) AS VARCHAR), '?') AS target FROM recording_metadata WHERE work_title IS NOT NULL)""")
def w02_duplicate_numbers(spark, folder):
    """The number of each claimant of one target name, in the order of paths."""
    m = table(spark, folder, "recording_metadata", "meta_id", "path", "work_title", "episode_number").where("work_title is not null")
    n = F.coalesce(F.when(F.col("episode_number") > 0, F.col("episode_number")).cast("string"), F.lit("?"))
    return R.number_duplicates(m.withColumn("target", F.concat("work_title", F.lit(" #"), n)), "target", ["path", "meta_id"], "meta_id")


@query("SELECT raw_id, title FROM (SELECT id AS raw_id, title FROM works WHERE media = 'tv' UNION SELECT id, title FROM works WHERE episodes_count > 12)")
def u01_union_of_candidates(spark, folder):
    """Candidates of two searches, each work once."""
    w = table(spark, folder, "works", "id", "title", "media", "episodes_count")
    return w.where("media = 'tv'").unionByName(w.where("episodes_count > 12")).select(F.col("id").alias("raw_id"), "title").distinct()


@query("SELECT meta_id, year(recorded_date) || '-' || CASE quarter(recorded_date) WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer' ELSE 'autumn' END AS season FROM recording_metadata WHERE recorded_date IS NOT NULL")
def e23_season_of_date(spark, folder):
    return table(spark, folder, "recording_metadata", "meta_id", "recorded_date").where("recorded_date is not null").select("meta_id", C.season_of(F.col("recorded_date")).alias("season"))


@query(f"SELECT id, {NUMBER_SQL} AS n FROM episodes")
def e26_episode_number(spark, folder):
    """The number that an episode goes by."""
    return table(spark, folder, "episodes", "id", "number", "number_text", "sort_number").select("id", C.episode_number(F.col("number"), F.col("number_text"), F.col("sort_number")).alias("n"))


@query(f"""SELECT id, whole || '.' || part AS fraction FROM (SELECT id, regexp_replace(regexp_extract(k, '([0-9]+)[.]([0-9]+)', 1), '^0+([0-9])', '\\1') AS whole, regexp_replace(regexp_extract(k, '([0-9]+)[.]([0-9]+)', 2), '0+$', '') AS part
FROM (SELECT id, {key_sql('number_text')} AS k FROM episodes) WHERE regexp_full_match(k, '(第|[#♯]|ep(isode)?\\.?)?[0-9]{{1,6}}[.][0-9]{{1,6}}話?')) WHERE part <> ''""")
def e28_fractional_label(spark, folder):
    """Labels that are fractions, canonical."""
    return table(spark, folder, "episodes", "id", "number_text").select("id", C.fractional_label(F.col("number_text")).alias("fraction")).where("fraction is not null")


@query(f"SELECT id, {title_key_sql('title')} AS k FROM works WHERE title IS NOT NULL")
def n06_title_key(spark, folder):
    return table(spark, folder, "works", "id", "title").where("title is not null").select("id", C.title_key(F.col("title")).alias("k"))


@query("""SELECT id, CASE WHEN regexp_matches(upper(regexp_extract(c, '^([^.]*)', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '＿' || c ELSE c END AS component FROM
(SELECT id, regexp_replace(regexp_replace(regexp_replace(translate(name, '/\\:*?"<>|', '／＼：＊？″＜＞｜'), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '^[ \\t　]+', ''), '[ \\t　.]+$', '') AS c FROM (SELECT DISTINCT id, name FROM recordings WHERE name IS NOT NULL))""")
def n22_path_component(spark, folder):
    """Names as components of a path."""
    r = table(spark, folder, "recordings", "id", "name").where("name is not null").distinct()
    return r.select("id", C.path_component(F.col("name")).alias("component"))


@query(f"""WITH s AS (SELECT DISTINCT tid, count, subtitle FROM {PROGRAMS_SQL} WHERE subtitle IS NOT NULL AND count > 0)
SELECT a.tid, a.count, a.subtitle AS a, b.subtitle AS b FROM s a JOIN s b ON a.tid = b.tid AND a.count = b.count AND a.subtitle < b.subtitle WHERE least(length(a.subtitle), length(b.subtitle)) >= 10 AND CASE length(a.subtitle) - length(b.subtitle)
WHEN 0 THEN len(list_filter(range(1, length(a.subtitle) + 1), lambda i: substr(a.subtitle, i, 1) <> substr(b.subtitle, i, 1))) = 1
WHEN 1 THEN len(list_filter(range(1, length(a.subtitle) + 1), lambda i: substr(a.subtitle, 1, i - 1) || substr(a.subtitle, i + 1) = b.subtitle)) > 0
WHEN -1 THEN len(list_filter(range(1, length(b.subtitle) + 1), lambda i: substr(b.subtitle, 1, i - 1) || substr(b.subtitle, i + 1) = a.subtitle)) > 0 ELSE false END""")
def f13_one_edit_apart(spark, folder):
    """Subtitles of one episode that differ by one character."""
    s = programs(spark, folder, "tid", "count", "subtitle").where("subtitle is not null and count > 0").select("tid", "count", "subtitle").distinct()
    a, b = s.withColumnRenamed("subtitle", "a"), s.withColumnRenamed("subtitle", "b")
    return a.join(b, ["tid", "count"]).where((F.col("a") < F.col("b")) & C.one_edit_apart(F.col("a"), F.col("b")))


@query("SELECT DISTINCT id FROM recordings WHERE loaded_at <= (SELECT max(loaded_at) FROM recordings) AND loaded_at >= (SELECT max(loaded_at) FROM recordings) - INTERVAL 7 DAY")
def f20_fresh(spark, folder):
    """Records loaded in the last seven days."""
    r = table(spark, folder, "recordings", "id", "loaded_at")
    now = F.broadcast(r.agg(F.max("loaded_at").alias("now")))
    return R.fresh(r.crossJoin(now), "loaded_at", F.col("now")).select("id").distinct()


@query("""SELECT id, (list_sort(list_transform(range(1, len(w) + 1), lambda i: {'j': CASE WHEN regexp_matches(w[i], '[ぁ-ヿ㐀-鿿]') THEN 1 ELSE 0 END, 'n': length(w[i]), 'i': -i, 'w': w[i]}), 'DESC'))[1].w AS keyword
FROM (SELECT id, list_filter(regexp_split_to_array(title, '[ 　]+'), lambda x: x <> '') AS w FROM works WHERE title IS NOT NULL)""")
def e31_search_keyword(spark, folder):
    """The word of a title to search a history by."""
    return table(spark, folder, "works", "id", "title").where("title is not null").select("id", C.search_keyword(F.col("title")).alias("keyword"))


@query(f"""SELECT id, array_to_string(list_filter(v, lambda x, i: x <> '' AND list_position(v, x) = i), '|') AS variants FROM (SELECT id, [title, translate(title, '{WIDE_SQL}', '{PLAIN_SQL}'), replace(replace(title, ' ', ''), '　', ''), translate(title, '〜・～', '   '), regexp_replace(title, ' ?(第[0-9]期|Season [0-9]|[0-9](nd|rd) Season|II|III)$', '')] AS v FROM works WHERE title IS NOT NULL)""")
def n24_search_variants(spark, folder):
    """Spellings to search a title by."""
    return table(spark, folder, "works", "id", "title").where("title is not null").select("id", F.array_join(C.search_variants(F.col("title")), "|").alias("variants"))


@query("SELECT meta_id, nullif(regexp_extract(path, '([^/]*)/[^/]*$', 1), '') AS folder FROM recording_metadata WHERE path IS NOT NULL")
def e22_folder_hint(spark, folder):
    return table(spark, folder, "recording_metadata", "meta_id", "path").where("path is not null").select("meta_id", C.folder_hint(F.col("path")).alias("folder"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE list_sort(list_filter(list_transform(string_split(a.p_name, ' '), lambda x: lower(x)), lambda x: x <> '')) = list_sort(list_filter(list_transform(string_split(b.p_name, ' '), lambda x: lower(x)), lambda x: x <> '')) AND len(list_filter(string_split(a.p_name, ' '), lambda x: x <> '')) >= 2""")
def f18_same_parts(spark, folder):
    """Names of one brand with the same words in any order: joined on the sorted words, not compared pair by pair."""
    p = table(spark, folder, "part", "p_partkey", "p_brand", "p_name")
    key = F.array_sort(F.filter(F.transform(F.split("p_name", " "), lambda x: F.lower(x)), lambda x: x != ""))
    p = p.withColumn("k", key).where(F.size("k") >= 2).select("p_partkey", "p_brand", "p_name", F.array_join("k", " ").alias("k"))
    a, b = p.select(F.col("p_partkey").alias("a"), "p_brand", "k", F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), "p_brand", "k", F.col("p_name").alias("y"))
    return a.join(b, ["p_brand", "k"]).where((F.col("a") < F.col("b")) & C.same_parts(F.col("x"), F.col("y"), " ")).select("a", "b")


@query("""WITH v AS (SELECT DISTINCT id, unnest(map_values(raw_extended)) AS x FROM recordings WHERE raw_extended IS NOT NULL)
SELECT id, count(DISTINCT x) AS kinds, CASE WHEN count(DISTINCT x) = 1 THEN min(x) END AS value FROM v WHERE trim(x) <> '' GROUP BY id""")
def a21_fields_agree(spark, folder):
    """Whether all extended fields of a recording say the same."""
    r = table(spark, folder, "recordings", "id", "raw_extended").select("id", F.explode(F.map_values("raw_extended")).alias("x")).distinct()
    return R.unique_or_null(r.where(F.trim("x") != ""), ["id"], "x", distinct=True).select("id", F.col("candidates").alias("kinds"), "value")


@query("""SELECT w.id AS work_id, count(e.id) AS listed, coalesce(w.episodes_count, 0) > 0 AND count(e.id) >= coalesce(w.episodes_count, 0) AS complete FROM works w LEFT JOIN episodes e ON e.work_id = w.id GROUP BY w.id, w.episodes_count""")
def f21_list_complete(spark, folder):
    """Whether a work's list covers what it declares: an incomplete one proves nothing."""
    n = table(spark, folder, "episodes", "id", "work_id").groupBy("work_id").agg(F.count("*").alias("n")).withColumnRenamed("work_id", "id")
    w = table(spark, folder, "works", "id", "episodes_count").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return w.select(F.col("id").alias("work_id"), F.col("n").alias("listed"), ((F.coalesce("episodes_count", F.lit(0)) > 0) & (F.col("n") >= F.coalesce("episodes_count", F.lit(0)))).alias("complete"))


@query("SELECT id, string_agg(filename, '|' ORDER BY filename) AS files FROM (SELECT DISTINCT id, unnest(video_files).filename AS filename FROM recordings) GROUP BY id")
def a23_file_list(spark, folder):
    """The files of a recording as one text, in order."""
    r = table(spark, folder, "recordings", "id", "video_files").select("id", F.explode("video_files").alias("v")).select("id", F.col("v.filename").alias("filename")).distinct()
    return r.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("filename")), "|").alias("files"))


@query("SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(DISTINCT work_title) AS works, CASE WHEN count(DISTINCT work_title) = 1 THEN min(work_title) END AS work FROM recording_metadata WHERE work_title IS NOT NULL GROUP BY 1")
def a19_folder_jobs(spark, folder):
    """The one work of each folder, or none."""
    m = table(spark, folder, "recording_metadata", "path", "work_title").where("work_title is not null").withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return R.unique_or_null(m, ["folder"], "work_title", distinct=True).select("folder", F.col("candidates").alias("works"), F.col("value").alias("work"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
