from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from normloom.operators import instants as I

CASES = [
    ("2024-03-01T10:20:30Z", None, "2024-03-01T10:20:30.000000Z"),
    ("2024-03-01T10:20:30.5Z", "UTC", "2024-03-01T10:20:30.500000Z"),
    ("2024-03-01T10:20:30.123456789", "UTC", "2024-03-01T10:20:30.123456Z"),
    ("2024-03-01 10:20:30", None, "2024-03-01T03:20:30.000000Z"),
    ("2024-03-01 10:20:30", "Europe/Paris", "2024-03-01T09:20:30.000000Z"),
    ("2024-03-01 10:20:30", "No/Where", "2024-03-01T03:20:30.000000Z"),
    ("2024-03-01 10:20:30 Europe/Paris", "UTC", "2024-03-01T09:20:30.000000Z"),
    ("2024-03-01 10:20:30 No/Where", "UTC", None),
    ("2024-03-01T10:20:30+0530", None, "2024-03-01T04:50:30.000000Z"),
    ("2024-03-01 10:20:30-05", None, "2024-03-01T15:20:30.000000Z"),
    ("21 Jul 2018 00:00:00 GMT+7", "UTC", "2018-07-20T17:00:00.000000Z"),
    ("Jul 3, 2024 09:07 PM", "UTC", "2024-07-03T21:07:00.000000Z"),
    ("Dec 2, 2023 12:00 AM", "UTC", "2023-12-02T00:00:00.000000Z"),
    ("26 September 2014", "UTC", "2014-09-26T00:00:00.000000Z"),
    ("05/07/2020", "UTC", "2020-07-05T00:00:00.000000Z"),
    ("5.7.2020", "UTC", "2020-07-05T00:00:00.000000Z"),
    ("05/07.2020", "UTC", None),
    ("08/07/2023 12:30 AM", "UTC", "2023-07-08T00:30:00.000000Z"),
    ("08/07/2023 13:30 PM", "UTC", None),
    ("20240229", "UTC", "2024-02-29T00:00:00.000000Z"),
    ("20230229", "UTC", None),
    ("ngày 02 tháng 05 năm 2022", "UTC", "2022-05-02T00:00:00.000000Z"),
    ("Ngày 2 tháng 5 năm 2022", None, "2022-05-01T17:00:00.000000Z"),
    ("02 giờ 15 ngày 8/9/2009", None, "2009-09-07T19:15:00.000000Z"),
    ("1540742611", "Europe/Paris", "2018-10-28T16:03:31.000000Z"),
    ("361361547", None, "1981-06-14T10:12:27.000000Z"),
    ("1635526800000", None, "2021-10-29T17:00:00.000000Z"),
    ("2020-13-05", None, None), ("0000-00-00", None, None), ("31/02/2021", None, None), ("N/A", None, None), ("-", None, None), ("theo văn bản gốc", None, None), ("", None, None), ("  ", None, None), (None, None, None),
    ("x" * 50_000, None, None),
    ("2024-03-10 02:30:00", "America/New_York", "2024-03-10T07:30:00.000000Z"),  # skipped: forward by the gap
    ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00.000000Z"),  # repeated: the earlier
    ("2024-10-06 02:15:00", "Australia/Sydney", "2024-10-05T16:15:00.000000Z"),
]


def test_every_format(spark):
    df = spark.createDataFrame([(i, "s", v, z, "clash") for i, (v, z, _) in enumerate(CASES)], "i int, source string, value string, tz_hint string, status string")
    out = I.to_instants(df).withColumn("utc", I.iso_utc(F.col("utc_micros")))
    got = {r["i"]: (r["utc"], r["status"]) for r in out.collect()}
    assert {i: got[i][0] for i in got} == {i: c[2] for i, c in enumerate(CASES)}
    assert {got[i][1] for i, c in enumerate(CASES) if c[2] is None and (c[0] or "").strip()} == {"unusable"}
    assert {got[i][1] for i, c in enumerate(CASES) if not (c[0] or "").strip()} == {"absent"}


def test_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_every_format(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["Europe/Paris", "Australia/Sydney", "America/New_York"])
def test_daylight_saving_against_zoneinfo(spark, zone):
    walls = [datetime(2023, m, d, h, 30) for m in (3, 4, 10, 11) for d in range(1, 32) for h in (0, 1, 2, 3) if not (m in (4, 11) and d == 31)]
    df = spark.createDataFrame([("s", w.strftime("%Y-%m-%d %H:%M:%S"), zone) for w in walls], "source string, value string, tz_hint string")
    got = {r["value"]: r["utc_micros"] for r in I.to_instants(df).collect()}
    for w in walls:
        assert got[w.strftime("%Y-%m-%d %H:%M:%S")] == int(w.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).timestamp()) * 1_000_000


def test_mixture_decides_by_source_or_says_that_it_cannot(spark):
    day = [("d", f"{d:02}/{m:02}/2020") for d in range(13, 28) for m in range(1, 13)] + [("d", "05/07/2020")]
    month = [("m", f"{m:02}/{d:02}/2020") for d in range(13, 28) for m in range(1, 13)] + [("m", "05/07/2020")]
    both = [("b", "25/01/2020"), ("b", "01/25/2020"), ("b", "05/07/2020")]
    df = spark.createDataFrame([(s, v, "UTC") for s, v in day + month + both], "source string, value string, tz_hint string")
    got = {r["source"]: (r["fmt"], r["status"]) for r in I.to_instants(df, day_first=False).where("value = '05/07/2020'").collect()}
    assert got["d"] == ("numeric_dmy", "resolved") and got["m"] == ("numeric_mdy", "resolved") and got["b"][1] == "ambiguous"


def keys(fmt, years=range(2010, 2025), n=30):
    return [(f"{fmt}@{y * 12 + m}", n) for y in years for m in range(1, 13)]


def test_dates_decide_between_a_rare_format_and_noise():
    """Eight digits that are no date in their usual order: day-first among the source's own years, noise in others, however large the source."""
    for n in (3, 30_000):
        odd = [(f"dmy8@{2020 * 12 + 12}", 1), (f"dmy8@{230 * 12 + 12}", 1), (f"dmy8@{231 * 12 + 2}", 2)]
        fitted = I.fit_mixture([*keys("ymd8", n=n), *odd, ("", 20 * n)])
        assert fitted[odd[0][0]][0] == "dmy8" and fitted[odd[1][0]][0] == I.NOISE == fitted[odd[2][0]][0] and fitted[""][0] == I.NOISE
    alone = I.fit_mixture([*keys("dmy8"), ("", 9)])
    assert all(alone[k][0] == "dmy8" for k, _ in keys("dmy8"))
    both = f"ymd8@{2010 * 12 + 12}|dmy8@{1201 * 12 + 10}"
    assert I.fit_mixture([*keys("ymd8"), *keys("dmy8"), (both, 1)])[both][0] == "ymd8"
    assert I.fit_mixture([]) == {} and I.fit_mixture([("", 1)]) == {"": (I.NOISE, 1.0)}


def test_the_mixture_decides_results(spark):
    """Without it the first valid reading would count: 20 December 230."""
    usual = [f"{y}{m:02}{d:02}" for y in range(2010, 2024) for m in range(1, 13) for d in (3, 17, 28)]
    df = spark.createDataFrame([("s", v, "UTC") for v in [*usual, "20120230", "31122020", "-"]], "source string, value string, tz_hint string")
    got = {r["value"]: (r["fmt"], r["status"]) for r in I.to_instants(df).where("value in ('20120230', '31122020', '20100103')").collect()}
    assert got == {"20120230": (None, "unusable"), "31122020": ("dmy8", got["31122020"][1]), "20100103": ("ymd8", "resolved")} and got["31122020"][1] in ("resolved", "ambiguous")


def test_empty(spark):
    df = spark.createDataFrame([], "source string, value string, tz_hint string")
    assert I.to_instants(df).collect() == []


def test_rare_formats_keep_their_dates():
    """A value of one format among a million with 5 % junk, also far from all other dates."""
    rare = (f"vi_long@{2015 * 12 + 3}", f"vi_clock@{1945 * 12 + 9}", f"ymd8@{1945 * 12 + 9}")
    fitted = I.fit_mixture([*keys("iso", n=5000), ("", 50_000), *((r, 1) for r in rare)])
    assert [fitted[r][0] for r in rare] == ["vi_long", "vi_clock", "ymd8"] and fitted[""][0] == I.NOISE


def test_many_sources_and_null_ones(spark):
    data = [(f"s{i}" if i % 7 else None, "05/07/2020", None) for i in range(60)]
    got = I.to_instants(spark.createDataFrame(data, "source string, value string, tz_hint string")).collect()
    assert len(got) == 60 and {r["status"] for r in got} == {"resolved"} and sum(r["source"] is None for r in got) == 9
