"""Queries of the timestamp operator, with the same cascade in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import timestamps as ts
from linkloom.operators.timestamps import normalise_timestamps
from linkloom.sources import table


def p4_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the three feeds with its instant (microseconds) and what was said of its text."""
    raw = table(spark, folder, "raw_programs", "raw_id", "feed", "channel_id", "started_at")
    zones = table(spark, folder, "schedule_channels", "channel_id", "tz").where("channel_id is not null").groupBy("channel_id").agg(F.min("tz").alias("tz"))
    return normalise_timestamps(raw.join(zones, "channel_id", "left"), "started_at", "tz")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = p4_instants(spark, folder).where("instant_status = 'ok'")
    return found.select("raw_id", F.floor(F.col("instant_us") / 1000).cast("long").alias("instant_ms")).distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that name no instant, by feed and reason."""
    return p4_instants(spark, folder).groupBy("feed", "instant_status").agg(F.count("*").alias("rows"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(value: str, pairs: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in pairs.items()) + " END"


def instants_sql() -> str:
    """CTEs that end in ``said``(raw_id, feed, instant_us, instant_status), with zones by DuckDB's own tables."""
    blanks = r"[\s\x{a0}\x{3000}\x{200b}\x{feff}]+"
    names = sorted({g for _, p in ts.PATTERNS for g in ts._groups(p)})
    parts = []
    for name, pattern in reversed(ts.PATTERNS):
        anchored, numbers = ts._plain(pattern)
        order = sorted(numbers, key=numbers.get)
        found = f"regexp_extract(t, {_quoted(anchored)}, [{', '.join(map(_quoted, order))}])"
        fields = ", ".join(f"{_quoted(g)}: " + (f"nullif({found}[{_quoted(g)}], '')" if g in numbers else "CAST(NULL AS VARCHAR)") for g in names)
        kind = f"{{'f': {_quoted(name)}, {fields}}}"
        parts.append((_quoted(anchored), kind))
    cascade = "NULL"
    for anchored, kind in parts:
        cascade = f"CASE WHEN regexp_matches(t, {anchored}) THEN {kind} ELSE {cascade} END"
    eras = ts.ERAS
    offset = "CASE WHEN p.\"offset\" = 'Z' THEN 0 ELSE (CASE WHEN p.\"offset\" LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(o, 1, 2) AS INTEGER) * 60 + coalesce(CAST(nullif(substr(o, 3, 2), '') AS INTEGER), 0)) END"
    clock_of = lambda u: f"epoch_us(timezone(z, make_timestamptz({u})))"
    return f"""WITH zones AS (SELECT channel_id, min(tz) AS tz FROM schedule_channels WHERE channel_id IS NOT NULL GROUP BY channel_id),
raw AS (SELECT r.raw_id, r.feed, z.tz, regexp_replace(translate(r.started_at, {_quoted(ts.WIDE)}, {_quoted(ts.NARROW)}), '^{blanks}|{blanks}$', '', 'g') AS t FROM raw_programs r LEFT JOIN zones z ON z.channel_id = r.channel_id),
split AS (SELECT *, {cascade} AS p FROM raw),
number AS (SELECT *, regexp_replace(p."offset", '[:Z+-]', '', 'g') AS o, CASE WHEN p.era IS NOT NULL THEN CASE WHEN p.y = '元' THEN 1 ELSE CAST(p.y AS INTEGER) END + {_case('p.era', {k: v[0] for k, v in eras.items()})} WHEN regexp_matches(p.y, '^[0-9]{{4}}$') THEN CAST(p.y AS INTEGER) END AS year,
  coalesce(CAST(p.m AS INTEGER), {_case('p.mon', {m: i + 1 for i, m in enumerate(ts.MONTHS)})}) AS month, CAST(p.d AS INTEGER) AS day, CAST(p.h AS INTEGER) AS hour, coalesce(CAST(p.mi AS INTEGER), CAST(p.mib AS INTEGER), 0) AS minute, coalesce(CAST(p.s AS INTEGER), CAST(p.sb AS INTEGER), 0) AS second, lower(p.ampm) AS half FROM split),
dated AS (SELECT *, CASE WHEN month BETWEEN 1 AND 12 AND day >= 1 AND year >= 1 THEN TRY_CAST(printf('%04d-%02d-%02d', year, month, day) AS DATE) END AS date,
  CASE WHEN half IS NULL THEN CASE WHEN hour <= 29 THEN hour END WHEN hour <= 12 AND half IN ('a', '午前') THEN hour % 12 WHEN hour <= 12 AND half IN ('p', '午後') THEN hour % 12 + 12 END AS clock FROM number),
local AS (SELECT *, CASE WHEN date IS NOT NULL AND clock IS NOT NULL AND minute BETWEEN 0 AND 59 AND second BETWEEN 0 AND 59 AND (p.week IS NULL OR isodow(date) - 1 = {_case('p.week', ts.WEEKDAYS)})
    AND (p.era IS NULL OR year(date) * 10000 + month(date) * 100 + day(date) BETWEEN {_case('p.era', {k: v[1] for k, v in eras.items()})} AND {_case('p.era', {k: v[2] for k, v in eras.items()})})
    THEN (datediff('day', DATE '1970-01-01', date) * 86400 + clock * 3600 + minute * 60 + second) * 1000000::BIGINT + coalesce(CAST(substr(rpad(p.frac, 9, '0'), 1, 6) AS BIGINT), 0) END AS l,
  coalesce({offset}, {_case('p.abbr', ts.ABBREVIATIONS)}) AS fixed, coalesce(p.region, nullif(trim(tz), '')) AS home,
  CASE WHEN p.f = 'epoch' THEN CASE WHEN length(p.epoch) <= 10 THEN CAST(p.epoch AS HUGEINT) * 1000000 WHEN length(p.epoch) <= 13 THEN CAST(p.epoch AS HUGEINT) * 1000 WHEN length(p.epoch) <= 16 THEN CAST(p.epoch AS HUGEINT) ELSE CAST(p.epoch AS HUGEINT) // 1000 END END AS e FROM dated),
zoned AS (SELECT l.*, CASE WHEN l.home IN (SELECT name FROM pg_timezone_names()) THEN l.home END AS z FROM local l),
tried AS (SELECT *, CASE WHEN l IS NOT NULL AND fixed IS NULL AND z IS NOT NULL THEN list_distinct([epoch_us(timezone(z, make_timestamp(l))), l - ({clock_of('l - 86400000000')} - (l - 86400000000)), l - ({clock_of('l + 86400000000')} - (l + 86400000000))]) END AS us FROM zoned),
fits AS (SELECT *, CASE WHEN us IS NOT NULL THEN [u FOR u IN us IF {clock_of('u')} = l] END AS c FROM tried),
said AS (SELECT raw_id, feed, CASE WHEN p.f = 'epoch' THEN CAST(e AS BIGINT) WHEN fixed IS NOT NULL THEN l - fixed * 60000000::BIGINT WHEN len(c) = 1 THEN c[1] END AS instant_us,
  CASE WHEN t IS NULL OR t = '' THEN 'missing' WHEN p IS NULL THEN 'unparsed' WHEN p.f <> 'epoch' AND l IS NULL THEN 'invalid' WHEN p.f = 'epoch' OR fixed IS NOT NULL THEN 'ok' WHEN z IS NULL THEN 'no_zone' WHEN len(c) = 0 THEN 'nonexistent' WHEN len(c) > 1 THEN 'ambiguous' ELSE 'ok' END AS instant_status FROM fits)
"""


def queries() -> dict:
    return {q.__name__: q for q in (p4_found, p4_report)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": instants_sql() + "SELECT DISTINCT raw_id, CAST(floor(instant_us / 1000.0) AS BIGINT) AS instant_ms FROM said WHERE instant_status = 'ok'",
        "p4_report": instants_sql() + "SELECT feed, instant_status, count(*) AS rows FROM said GROUP BY feed, instant_status",
    }
