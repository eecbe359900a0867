"""Mixed timestamp texts to one instant, by an ordered cascade of anchored patterns.

Everything stays in the JVM: one regular expression a format, parsed strictly, integer arithmetic on the parts, and the
zone rules of the JVM for local times. The result never depends on the session's time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = 1_000_000
DAY_US = 86_400 * US

# Full-width characters that occur in dates, and what they stand for.
WIDE = "０１２３４５６７８９：／－．＋，（）　ＴＺ"
NARROW = "0123456789:/-.+,() TZ"

# First year of an era less one, first and last day (yyyymmdd) of it.
ERAS = {"明治": (1867, 18680125, 19120730), "大正": (1911, 19120730, 19261225), "昭和": (1925, 19261225, 19890107), "平成": (1988, 19890108, 20190430), "令和": (2018, 20190501, 99991231)}

# Zone abbreviations and their minutes from UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS = {"Mon": 0, "Tue": 1, "Wed": 2, "Thu": 3, "Fri": 4, "Sat": 5, "Sun": 6, "月": 0, "火": 1, "水": 2, "木": 3, "金": 4, "土": 5, "日": 6}

_FRACTION = r"(?:[.,](?<frac>\d{1,9}))?"
_OFFSET = r"(?:\s*(?<offset>Z|[+-]\d{2}:?\d{2}|[+-]\d{2}))?"
_REGION = r"(?:\[(?<region>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+|UTC|GMT|Z)\])?"
_ABBR = r"(?:\s*(?<abbr>" + "|".join(sorted(ABBREVIATIONS, key=lambda x: (-len(x), x))) + "))?"
_ZONE = f"{_OFFSET}{_REGION}{_ABBR}"
_JWEEK = r"(?:\s*\((?<week>[月火水木金土日])\))?"
_EWEEK = r"(?:(?<week>Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+)?"
_MON = "(?<mon>" + "|".join(MONTHS) + r")[a-z]*\.?"
_HMS = r"(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})" + _FRACTION + ")?"
_AMPM = r"(?:\s*(?<ampm>[AaPp])\.?[Mm]\.?)?"

#: The cascade: the first pattern that fits the whole text decides, also where its parts then name no instant.
PATTERNS: list[tuple[str, str]] = [
    ("epoch", r"(?<epoch>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})"),
    ("compact", r"(?<y>\d{4})(?<m>\d{2})(?<d>\d{2})(?:T|\s?)(?<h>\d{2})(?<mi>\d{2})(?:(?<s>\d{2})" + _FRACTION + ")?" + _ZONE),
    ("iso", r"(?<y>\d{4})-(?<m>\d{1,2})-(?<d>\d{1,2})(?:T|\s+)" + _HMS + _AMPM + _ZONE),
    ("slash", r"(?<y>\d{4})[/.](?<m>\d{1,2})[/.](?<d>\d{1,2})" + _JWEEK + r"\s+" + _HMS + _AMPM + _ZONE),
    ("kanji", r"(?<era>明治|大正|昭和|平成|令和)?(?<y>\d{1,4}|元)年\s*(?<m>\d{1,2})月\s*(?<d>\d{1,2})日" + _JWEEK + r"\s*(?<ampm>午前|午後)?\s*(?<h>\d{1,2})(?:時\s*(?:(?<mi>\d{1,2})分\s*(?:(?<s>\d{1,2})秒)?)?|:(?<mib>\d{2})(?::(?<sb>\d{2}))?)" + _ZONE),
    ("dayfirst", _EWEEK + r"(?<d>\d{1,2})\s+" + _MON + r",?\s+(?<y>\d{4}),?\s+" + _HMS + _AMPM + _ZONE),
    ("monthfirst", _EWEEK + _MON + r"\s+(?<d>\d{1,2}),?\s+(?<y>\d{4}),?\s+" + _HMS + _AMPM + _ZONE),
]


@dataclass(frozen=True)
class LocalPolicy:
    """What a local time means that its zone skips (nonexistent) or has twice (ambiguous).

    'reject' gives no instant; ambiguous may be 'earlier' or 'later'; nonexistent may be 'shift' (by the length of the gap).
    """

    ambiguous: str = "reject"
    nonexistent: str = "reject"


def _groups(pattern: str) -> list[str]:
    import re

    return re.findall(r"\(\?<([a-z]+)>", pattern)


def _plain(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern, anchored, and the number of each named group."""
    import re

    numbers, n = {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((?!\?)|\(\?<(?P<name>[a-z]+)>", pattern):
        if m[0].startswith("(") :
            n += 1
            if m["name"]:
                numbers[m["name"]] = n
    return "^(?:" + re.sub(r"\(\?<[a-z]+>", "(", pattern) + ")$", numbers


def _lookup(value: Column, pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[value]


def _fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns, computed here once: the one-row explode keeps the optimiser from copying their
    expressions into everything above, filters included."""
    name = "__ll_fence"
    kept = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias(name))
    return out.select(*kept, *[F.col(name)[k].alias(k) for k in columns])


def local_candidates(local_us: Column, zone: Column) -> Column:
    """All instants (microseconds) at which the clock of ``zone`` shows ``local_us`` (microseconds, read as if UTC)."""
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))

    def offset(at: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), zone)) - at

    tried = F.array_distinct(F.array(first, local_us - offset(first - F.lit(DAY_US)), local_us - offset(first + F.lit(DAY_US))))
    return F.array_sort(F.filter(tried, lambda u: u + offset(u) == local_us))


def normalise_timestamps(df: DataFrame, text: str, zone: str, out: str = "instant_us", status: str = "instant_status", policy: LocalPolicy = LocalPolicy()) -> DataFrame:
    """``df`` with ``out`` BIGINT (microseconds since 1970-01-01 UTC, or null) and ``status`` STRING.

    ``text`` is a column of free timestamps, ``zone`` one of IANA zone names for texts without a zone. Status: 'ok',
    'missing' (null, blank), 'unparsed' (no pattern fits the whole text), 'invalid' (an impossible date, hour or weekday),
    'no_zone' (a local time, but no usable zone), 'ambiguous' or 'nonexistent' (by the zone's changes; see ``policy``).
    Hours from 24 to 29 belong to the night after the date (a broadcast day); 12-hour clocks take 0 to 12. Epoch numbers
    of 9-10, 12-13, 15-16 and 18-19 digits are seconds, milli-, micro- and nanoseconds; seconds and fractions not given
    are zero; digits below the microsecond are cut. An offset in the text wins over a zone name, that over ``zone``.
    Rows are kept one to one, repeated rows too; other columns pass through, whatever their names.
    """
    base, taken = "__ll_ts", set(df.columns)
    while any(c.startswith(base) for c in taken):
        base += "_"
    raw = F.translate(df[f"`{text}`"], WIDE, NARROW)
    clean = F.regexp_replace(raw, r"^[\s\u00a0\u3000\u200b\ufeff]+|[\s\u00a0\u3000\u200b\ufeff]+$", "")
    work = df.withColumn(f"{base}t", clean)
    t = F.col(f"{base}t")
    names = sorted({g for _, p in PATTERNS for g in _groups(p)})
    split = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        anchored, numbers = _plain(pattern)
        # one match writes all parts, in the order of names, behind the pattern's name
        written = "|".join([name, *[f"${numbers[g]}" if g in numbers else "" for g in names]])
        split = F.when(t.rlike(anchored), F.regexp_replace(t, anchored, written)).otherwise(split)
    work = _fenced(work, **{f"{base}a": F.split(split, r"\|")})
    array = F.col(f"{base}a")
    f = array[0]
    work = work.withColumn(f"{base}p", F.struct(*[F.nullif(array[i + 1], F.lit("")).alias(g) for i, g in enumerate(names)]))
    p = F.col(f"{base}p")
    number = lambda c: c.cast("int")
    year = F.when(p["era"].isNotNull(), F.when(p["y"] == "元", F.lit(1)).otherwise(number(p["y"])) + _lookup(p["era"], {k: v[0] for k, v in ERAS.items()})).when(p["y"].rlike(r"^\d{4}$"), number(p["y"]))
    month = F.coalesce(number(p["m"]), _lookup(p["mon"], {m: i + 1 for i, m in enumerate(MONTHS)}))
    hour, minute, second = number(p["h"]), F.coalesce(number(p["mi"]), number(p["mib"]), F.lit(0)), F.coalesce(number(p["s"]), number(p["sb"]), F.lit(0))
    day = number(p["d"])
    date = F.when((month.between(1, 12)) & (day >= 1) & (year >= 1) & (day <= F.dayofmonth(F.last_day(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1))))), F.make_date(year, month, day))
    work = _fenced(work, **{f"{base}d": date})
    d = F.col(f"{base}d")
    half = F.lower(p["ampm"])
    clock = F.when(half.isNull(), F.when(hour <= 29, hour)).when((hour <= 12) & half.isin("a", "午前"), hour % 12).when((hour <= 12) & half.isin("p", "午後"), hour % 12 + 12)
    era_day = F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)
    valid = d.isNotNull() & clock.isNotNull() & minute.between(0, 59) & second.between(0, 59)
    valid &= p["week"].isNull() | (F.weekday(d) == _lookup(p["week"], WEEKDAYS))
    valid &= p["era"].isNull() | era_day.between(_lookup(p["era"], {k: v[1] for k, v in ERAS.items()}), _lookup(p["era"], {k: v[2] for k, v in ERAS.items()}))
    fraction = F.coalesce(F.substring(F.rpad(p["frac"], 9, "0"), 1, 6).cast("long"), F.lit(0).cast("long"))
    seconds = F.unix_date(d).cast("long") * 86400 + clock.cast("long") * 3600 + minute * 60 + second
    digits = F.regexp_replace(p["offset"], "[:Z+-]", "")
    minutes = F.when(p["offset"] == "Z", F.lit(0)).otherwise(F.when(p["offset"].startswith("-"), F.lit(-1)).otherwise(1) * (F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))))
    fixed = F.coalesce(minutes, _lookup(p["abbr"], ABBREVIATIONS))
    length = F.length(p["epoch"])
    epoch = p["epoch"].cast("long")
    epoch_us = F.when(length <= 10, epoch * US).when(length <= 13, epoch * 1000).when(length <= 16, epoch).otherwise(F.floor(epoch / 1000).cast("long"))
    home = F.coalesce(p["region"], F.nullif(F.trim(df[f"`{zone}`"]), F.lit("")))
    # a zone that the JVM doesn't know would end the job
    known = home.isin(sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds()))
    work = _fenced(work, **{f"{base}l": F.when(valid, seconds * US + fraction), f"{base}o": fixed, f"{base}z": F.when(known, home), f"{base}e": F.when(f == "epoch", epoch_us)})
    local, z = F.col(f"{base}l"), F.col(f"{base}z")
    needs = local.isNotNull() & F.col(f"{base}o").isNull() & z.isNotNull()
    # zones are looked up only for rows that need them, so that a fixed offset costs nothing
    work = _fenced(work, **{f"{base}c": F.when(needs, local_candidates(local, F.coalesce(z, F.lit("UTC"))))})
    c = F.col(f"{base}c")
    first_guess = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.coalesce(z, F.lit("UTC"))))
    by_zone = F.when(F.size(c) == 1, c[0])
    if policy.ambiguous != "reject":
        by_zone = F.when(F.size(c) > 1, F.element_at(c, 1 if policy.ambiguous == "earlier" else -1)).otherwise(by_zone)
    if policy.nonexistent == "shift":
        by_zone = F.when(F.size(c) == 0, first_guess).otherwise(by_zone)
    instant = F.when(f == "epoch", F.col(f"{base}e")).when(F.col(f"{base}o").isNotNull(), local - F.col(f"{base}o").cast("long") * 60 * US).when(needs, by_zone)
    said = (
        F.when(t.isNull() | (t == ""), "missing")
        .when(f.isNull(), "unparsed")
        .when((f != "epoch") & local.isNull(), "invalid")
        .when((f == "epoch") | F.col(f"{base}o").isNotNull(), "ok")
        .when(z.isNull(), "no_zone")
        .when((F.size(c) == 0), "ok" if policy.nonexistent == "shift" else "nonexistent")
        .when((F.size(c) > 1), "ok" if policy.ambiguous != "reject" else "ambiguous")
        .otherwise("ok")
    )
    work = _fenced(work, **{f"{base}i": instant, f"{base}s": said})
    keep = [F.col(f"`{x}`") for x in df.columns if x not in (out, status)]
    return work.select(*keep, F.col(f"{base}i").alias(out), F.col(f"{base}s").alias(status))
