import datetime
from zoneinfo import ZoneInfo

import pytest

from linkloom.operators.timestamps import LocalPolicy, normalise_timestamps

CASES = [
    ("2013-10-02 09:40:00 JST", "Europe/Paris", "ok", (2013, 10, 2, 0, 40)),
    ("２０２４／９／１１ ０：４０", "Asia/Tokyo", "ok", (2024, 9, 10, 15, 40)),
    ("2013年1月29日 午後0時05分", "Asia/Tokyo", "ok", (2013, 1, 29, 3, 5)),
    ("令和元年5月1日 8:00", "Asia/Tokyo", "ok", (2019, 4, 30, 23, 0)),
    ("平成31年5月1日 8:00", "Asia/Tokyo", "invalid", None),
    ("2016-04-01 24:45", "Asia/Tokyo", "ok", (2016, 4, 1, 15, 45)),
    ("2016-04-01 30:00", "Asia/Tokyo", "invalid", None),
    ("20180408T114514+0900", None, "ok", (2018, 4, 8, 2, 45, 14)),
    ("1347156033", "Asia/Tokyo", "ok", (2012, 9, 9, 2, 0, 33)),
    ("1347156033000000", "Asia/Tokyo", "ok", (2012, 9, 9, 2, 0, 33)),
    ("Jan 9, 2013 12:10 AM JST", "Asia/Tokyo", "ok", (2013, 1, 8, 15, 10)),
    ("Mon, 09 Sep 2024 20:55:00 +0900", "Asia/Tokyo", "ok", (2024, 9, 9, 11, 55)),
    ("Tue, 09 Sep 2024 20:55:00 +0900", "Asia/Tokyo", "invalid", None),
    ("2024-03-10T02:30:00", "America/New_York", "nonexistent", None),
    ("2024-11-03T01:30:00", "America/New_York", "ambiguous", None),
    ("2024-11-03T01:30:00-05:00", "America/New_York", "ok", (2024, 11, 3, 6, 30)),
    ("2017-11-01T17:40:00[Asia/Tokyo]", "Europe/Paris", "ok", (2017, 11, 1, 8, 40)),
    ("2017-11-01T17:40:00[Nowhere/Else]", "Europe/Paris", "no_zone", None),
    ("2017-11-01 17:40", None, "no_zone", None),
    ("2017-11-01 17:40", "No/Such", "no_zone", None),
    ("2024/4/31 9:30", "Asia/Tokyo", "invalid", None),
    ("0000-00-00 00:00:00", "Asia/Tokyo", "invalid", None),
    ("未定", "Asia/Tokyo", "unparsed", None),
    ("0", "Asia/Tokyo", "unparsed", None),
    ("　", "Asia/Tokyo", "missing", None),
    (None, "Asia/Tokyo", "missing", None),
    ("9" * 5_000, "Asia/Tokyo", "unparsed", None),
    ("2016-02-29 12:00", "UTC", "ok", (2016, 2, 29, 12, 0)),
]


def test_cases(spark):
    rows = [(i, *c[:2], 7) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, t string, z string, instant_us int")
    out = {r["id"]: r for r in normalise_timestamps(df, "t", "z").collect()}
    assert len(out) == len(CASES)
    for i, (text, _, status, want) in enumerate(CASES):
        assert out[i]["instant_status"] == status, text
        assert out[i]["instant_us"] == (None if want is None else int(datetime.datetime(*want, tzinfo=datetime.UTC).timestamp()) * 10**6), text
    assert normalise_timestamps(df.limit(0), "t", "z").count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Asia/Tokyo"])
def test_local_times_equal_brute_force(spark, zone):
    """Every instant whose clock shows the time, by trying all quarter hours around it."""
    tz = ZoneInfo(zone)
    days = [(2024, 3, 10), (2024, 3, 31), (2024, 4, 7), (2024, 10, 6), (2024, 10, 27), (2024, 11, 3)]
    times = [datetime.datetime(*d) + datetime.timedelta(minutes=15 * k) for d in days for k in range(16)]
    df = spark.createDataFrame([(i, t.strftime("%Y-%m-%d %H:%M"), zone) for i, t in enumerate(times)], "id int, t string, z string")
    got = {r["id"]: (r["instant_status"], r["instant_us"]) for r in normalise_timestamps(df, "t", "z").collect()}
    earlier = {r["id"]: r["instant_us"] for r in normalise_timestamps(df, "t", "z", policy=LocalPolicy("earlier", "shift")).collect()}
    for i, t in enumerate(times):
        near = [t.replace(tzinfo=datetime.UTC) + datetime.timedelta(minutes=15 * k) for k in range(-70, 71)]
        hits = [u for u in near if u.astimezone(tz).replace(tzinfo=None) == t]
        status = {0: "nonexistent", 1: "ok", 2: "ambiguous"}[len(hits)]
        assert got[i] == (status, int(hits[0].timestamp()) * 10**6 if status == "ok" else None), (zone, t)
        if hits:
            assert earlier[i] == int(hits[0].timestamp()) * 10**6
        else:
            assert earlier[i] is not None
