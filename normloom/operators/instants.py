"""Mixed timestamp formats and time zones to one instant.

Method: expectation-maximisation over format mixtures per source. A written value is matched against every format; the
formats that give it a valid date are its candidates. A source's mixture has a weight per format and, per format, a density of
dates by month, smoothed by the density of all its dates. Every value contributes the likelihood of each of its readings (weight times density at the month
read); a noise component stands for strings of digits that only happen to make a date. The posteriors choose the reading
and say where they don't decide. Values of one source with the same candidates in the same months are interchangeable, so each source is fitted on
counts of those, in a task of its own; their number is bounded by the calendar, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.plans.session import Scratch

#: English month names, the first three letters decide.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

ZONE = r"(Z|z|(?:GMT|UTC)(?:[+-]\d{1,2}(?::?\d{2})?)?|[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+)?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: Shape, its pattern and the group numbers of year, month, day, hour, minute, second, fraction, am/pm and zone (0: none).
SHAPES = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]{CLOCK})? ?{ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    "numeric": (rf"^(\d{{1,2}})([/.\-])(\d{{1,2}})\2(\d{{4}})(?: {CLOCK}(?: ?([AaPp])\.?[Mm]\.?)?)? ?{ZONE}$", (4, 3, 1, 5, 6, 7, 8, 9, 10)),
    "vi_long": (r"(?i)^ng\S{1,4}y (\d{1,2}) th\S{1,4}ng (\d{1,2}) n\S{1,3}m (\d{4})$", (3, 2, 1, 0, 0, 0, 0, 0, 0)),
    "vi_clock": (r"(?i)^(\d{1,2}) gi\S{1,4} (\d{1,2})(?: ph\S{1,3}t)?,? ng\S{1,4}y (\d{1,2})/(\d{1,2})/(\d{4})$", (5, 4, 3, 1, 2, 0, 0, 0, 0)),
    "day_name": (rf"^(\d{{1,2}}) ([A-Za-z]{{3,9}})\.?,? (\d{{4}})(?:,? {CLOCK}(?: ?([AaPp])\.?[Mm]\.?)?)? ?{ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "name_day": (rf"^([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}})(?:,? {CLOCK}(?: ?([AaPp])\.?[Mm]\.?)?)? ?{ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
}
#: Readings of a shape other than the one its group numbers give. Each is a format of its own in the mixture.
FORMATS = ("iso", "numeric_dmy", "numeric_mdy", "vi_long", "vi_clock", "day_name", "name_day", "ymd8", "dmy8", "epoch_s", "epoch_ms")
NOISE = "noise"
#: Formats whose values may as well be noise: bare digits that are no date in their usual order.
NOISE_PRONE = ("dmy8",)
#: Parts of a value by their place in the replacement that pulls them apart.
PARTS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone")
#: Months of the calendar, over which noise is spread evenly.
MONTHS_IN_ALL = 9999 * 12


def known_zones(spark) -> list[str]:
    """The zone names of the JVM that evaluates them."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _wall(y: Column, mo: Column, d: Column, seconds: Column, micros: Column) -> Column:
    """Microseconds of a wall time as if in UTC; null where there is no such day."""
    day = F.format_string("%04d-%02d-%02d", y, mo, d).try_cast("date")
    return F.when(y.between(1, 9999) & mo.between(1, 12) & d.between(1, 31), (F.unix_date(day).cast("bigint") * 86400 + seconds) * 1_000_000 + micros)


def with_candidates(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds _cands, an array of struct(fmt, wall): each format under which the value is a valid date, wall in microseconds;
    and _zone, the zone or offset that the value itself states. Values are read with runs of white space as one blank."""
    v = F.trim(F.regexp_replace(F.translate(F.col(value), "\u00a0\u3000", "  "), r"\s+", " "))
    df = df.withColumn("_v", v)
    # One match per shape pulls all parts apart: they come joined by a character that no written date has.
    parts, shape = F.when(F.lit(False), F.array().cast("array<string>")), F.when(F.col("_v").rlike(r"^\d{8,13}$"), F.lit("digits"))
    for name, (pattern, groups) in SHAPES.items():
        hit = F.col("_v").rlike(pattern)
        parts = parts.when(hit, F.split(F.regexp_replace("_v", pattern, "\x01".join(f"${g}" if g else "" for g in groups)), "\x01"))
        shape = shape.when(hit, F.lit(name))
    df = df.withColumns({"_shape": shape, "_parts": parts})

    month = F.lower(F.substring(F.col("_month"), 1, 3))
    by_name = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    df = df.withColumns({f"_{n}": F.get("_parts", k) for k, n in enumerate(PARTS)}).drop("_parts")
    num = lambda n: F.col(n).try_cast("int")
    hour, half = F.coalesce(num("_hour"), F.lit(0)), F.upper(F.coalesce("_half", F.lit("")))
    minute, second = F.coalesce(num("_minute"), F.lit(0)), F.coalesce(num("_second"), F.lit(0))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0)).otherwise(F.when(half == "A", F.when(hour == 0, 0)))
    good_clock = hour24.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    seconds = F.when(good_clock, (hour24 * 3600 + minute * 60 + second).cast("bigint"))
    micros = F.rpad(F.substring(F.coalesce("_fraction", F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    y, d = num("_year"), num("_day")
    m = F.when(F.col("_shape").isin("day_name", "name_day"), F.element_at(by_name, month)).otherwise(num("_month"))
    df = df.withColumns({"_seconds": seconds, "_micros": micros, "_m": m})
    s, u, mm = F.col("_seconds"), F.col("_micros"), F.col("_m")
    digits, size, zero = F.col("_shape") == "digits", F.length("_v"), F.lit(0).cast("bigint")
    cut = lambda a, n: F.substring("_v", a, n).try_cast("int")
    of = F.col("_shape")
    readings = {
        "iso": F.when(of == "iso", _wall(y, mm, d, s, u)),
        "numeric_dmy": F.when(of == "numeric", _wall(y, mm, d, s, u)),
        "numeric_mdy": F.when(of == "numeric", _wall(y, d, mm, s, u)),
        "vi_long": F.when(of == "vi_long", _wall(y, mm, d, s, u)),
        "vi_clock": F.when(of == "vi_clock", _wall(y, mm, d, s, u)),
        "day_name": F.when(of == "day_name", _wall(y, mm, d, s, u)),
        "name_day": F.when(of == "name_day", _wall(y, mm, d, s, u)),
        "ymd8": F.when(digits & (size == 8), _wall(cut(1, 4), cut(5, 2), cut(7, 2), zero, zero)),
        "dmy8": F.when(digits & (size == 8), _wall(cut(5, 4), cut(3, 2), cut(1, 2), zero, zero)),
        "epoch_s": F.when(digits & size.isin(9, 10), F.col("_v").try_cast("bigint") * 1_000_000),
        "epoch_ms": F.when(digits & size.isin(12, 13), F.col("_v").try_cast("bigint") * 1000),
    }
    cands = F.filter(F.array(*[F.struct(F.lit(f).alias("fmt"), readings[f].alias("wall")) for f in FORMATS]), lambda c: c["wall"].isNotNull())
    df = df.withColumn("_cands", cands).withColumn("_zone", F.when(F.col("_zone") != "", F.col("_zone")))
    return df.drop("_v", "_shape", "_year", "_month", "_day", "_hour", "_minute", "_second", "_fraction", "_half", "_seconds", "_micros", "_m")


def _date_density(months: np.ndarray, mass: np.ndarray, spread: float) -> np.ndarray:
    """The density of dates at the given months: half the month's own share, half that of the three years around it, and a trace (spread) of an
    even one over the whole calendar."""
    share = mass / max(mass.sum(), 1e-300)
    order = np.argsort(months)
    total = np.concatenate([[0.0], np.cumsum(share[order])])
    near = total[np.searchsorted(months[order], months + 18, "right")] - total[np.searchsorted(months[order], months - 18, "left")]
    return (1 - spread) * (0.5 * share + 0.5 * near / 37) + spread / MONTHS_IN_ALL


def fit_mixture(counts: Iterable[tuple[str, int]], prior: dict[str, float] | None = None, least: float = 1e-3, spread: float = 1e-3, trust: float = 1e-4, rounds: int = 200) -> dict[str, tuple[str, float]]:
    """candidates -> (format, posterior) of one source, from the counts of its values' candidates: 'format@month' joined by '|', months
    counted from year 0, '' where a value has none.

    prior multiplies the weight of a format: 0 rules it out. No weight falls below least, whatever the number of values, so a rare format isn't
    lost in a large source. A format's density is that of its own values and, as one value more, of all the source's dates; a
    noise-prone format has the latter alone, to which its own values add only trust each, so that junk doesn't vouch for junk. The noise
    component takes all values without candidates and competes for those that only noise-prone formats explain; its
    likelihood is even over all months. Any other reading is never given up for noise.
    """
    prior = prior or {}
    names = [f for f in FORMATS if prior.get(f, 1.0) > 0]
    index = {f: i for i, f in enumerate(names)}
    keys, sizes, entries = [], [], []
    for key, n in counts:
        for c in filter(None, key.split("|")):
            f, m = c.split("@")
            if f in index:
                entries.append((len(keys), index[f], int(m)))
        keys.append(key)
        sizes.append(float(n))
    n, k_all, f_all = np.array(sizes), len(keys), len(names)
    if not k_all:
        return {}
    k, f, month = (np.array(x, dtype=np.int64) for x in (zip(*entries) if entries else ([], [], [])))
    prone = np.isin(f, [index[x] for x in NOISE_PRONE if x in index])
    sound = np.bincount(k[~prone], minlength=k_all) > 0  # has a reading that isn't noise-prone
    months, at = np.unique(month, return_inverse=True)
    share = n[k] * np.where(sound[k], 1.0, trust) / np.maximum(np.bincount(k, minlength=k_all)[k], 1)
    of_source = _date_density(months, np.bincount(at, weights=share, minlength=len(months)), spread)
    own = np.array([x not in NOISE_PRONE for x in names])
    scale = np.array([prior.get(x, 1.0) for x in names])
    noise = np.where(sound, 0.0, np.where(np.bincount(k, minlength=k_all) > 0, 1 / MONTHS_IN_ALL, 1.0))
    weight, density = np.full(f_all + 1, 1 / (f_all + 1)), np.tile(of_source, (f_all, 1))
    for _ in range(rounds):
        like = weight[f] * scale[f] * density[f, at]
        like_noise = weight[-1] * noise
        whole = np.bincount(k, weights=like, minlength=k_all) + like_noise
        post, post_noise = like / whole[k], like_noise / whole
        got = np.bincount(f, weights=n[k] * post, minlength=f_all)
        cells = np.zeros_like(density)
        np.add.at(cells, (f, at), n[k] * post)
        density = np.where(own[:, None], (cells + of_source) / (got[:, None] + 1), of_source)
        new = np.maximum(np.append(got, n @ post_noise) / n.sum(), least)
        new /= new.sum()
        done = np.abs(new - weight).max() < 1e-9
        weight = new
        if done:
            break
    best = [(float(p), NOISE) for p in post_noise]
    for i, j, p in sorted(zip(k.tolist(), f.tolist(), post.tolist())):
        if p > best[i][0]:
            best[i] = (p, names[j])
    return {key: (name, p) for key, (p, name) in zip(keys, best, strict=True)}


def _fit_source(source: str, prior: dict[str, float]):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        fitted = fit_mixture(zip(frame["_key"], frame["n"].astype(int)), prior)
        return pd.DataFrame([(key[0], k, f, p) for k, (f, p) in fitted.items()], columns=[source, "_key", "fmt", "posterior"])

    return run


def to_instants(
    df: DataFrame, source: str = "source", value: str = "value", hint: str = "tz_hint", default_zone: str = "Asia/Ho_Chi_Minh", day_first: bool = True, sure: float = 0.95
) -> DataFrame:
    """Adds fmt, posterior, status and utc_micros to df.

    status: 'resolved' (posterior at least sure), 'ambiguous' (the posteriors of the source don't decide; the likeliest reading is
    given), 'unusable' (no valid reading, or only a second one that the source's weights and dates speak against; utc_micros null), 'absent' (null or
    blank). day_first states that numeric dates with the year last have the day first, a prior of 0 for the
    other reading; without it the source's own mixture decides. The zone or offset in the value decides, else
    the hint, else default_zone; a zone name in the value that doesn't exist makes it unusable, an unknown hint counts as none.
    Wall times skipped by daylight saving move forward by the gap, repeated ones mean the earlier instant. A null source is a
    source of its own. Columns of df that have the names of the added ones are replaced.

    The counts of a source's candidates go to one task per source (at most formats x months of them, however many rows) and
    the choices are joined back; nothing comes to the driver.
    """
    spark = df.sparkSession
    df = df.drop("fmt", "posterior", "status", "utc_micros").withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("\x00")))
    day = lambda c: F.date_from_unix_date(F.floor(c["wall"] / F.lit(86_400_000_000)).cast("int"))
    marked = lambda c: F.concat_ws("@", c["fmt"], (F.year(day(c)) * 12 + F.month(day(c))).cast("string"))
    read = with_candidates(df, value).withColumn("_key", F.array_join(F.transform("_cands", marked), "|"))
    read = Scratch(spark, "instants").write(read, "read")  # each value is read once, for the counts and for the result
    counts = read.where(F.trim(F.col(value)) != "").groupBy("_source", "_key").agg(F.count("*").alias("n"))
    choice = counts.groupBy("_source").applyInPandas(_fit_source("_source", {"numeric_mdy": 0.0} if day_first else {}), "_source string, _key string, fmt string, posterior double")
    read = read.join(choice, ["_source", "_key"], "left")

    zones = known_zones(spark)
    named = F.col("_zone").contains("/")
    offset = F.regexp_extract(F.coalesce("_zone", F.lit("")), r"([+-])(\d{1,2}):?(\d{2})?$", 0)
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(offset, r"^[+-](\d{1,2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(offset, r"^[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    shift = F.when(F.col("_zone").isNull() | named, None).when(offset == "", F.lit(0)).otherwise(sign * (hours * 3600 + minutes * 60))
    hinted = F.when(F.trim(F.col(hint)).isin(zones), F.trim(F.col(hint))).otherwise(F.lit(default_zone))
    zone = F.when(named, F.when(F.col("_zone").isin(zones), F.col("_zone"))).otherwise(hinted)
    wall = F.get(F.filter("_cands", lambda c: c["fmt"] == F.col("fmt")), 0)["wall"]
    epoch = F.col("fmt").startswith("epoch")
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("_wall")), F.col("_tz")))
    read = read.withColumns({"_wall": wall, "_tz": zone, "_shift": shift.cast("bigint")})
    utc = F.when(epoch, F.col("_wall")).when(F.col("_shift").isNotNull(), F.col("_wall") - F.col("_shift") * 1_000_000).when(F.col("_tz").isNotNull(), local)
    read = read.withColumn("utc_micros", utc)
    absent = F.col(value).isNull() | (F.trim(F.col(value)) == "")
    status = F.when(absent, "absent").when(F.col("utc_micros").isNull(), "unusable").when(F.col("posterior") < sure, "ambiguous").otherwise("resolved")
    read = read.withColumn("status", status).withColumn("fmt", F.when(F.col("utc_micros").isNotNull(), F.col("fmt")))
    return read.drop("_source", "_key", "_cands", "_zone", "_wall", "_tz", "_shift")


def iso_utc(micros: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's zone."""
    seconds = F.call_function("div", micros - F.pmod(micros, F.lit(1_000_000)), F.lit(1_000_000))
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400))
    return F.concat(day, F.format_string("T%02d:%02d:%02d.%06dZ", F.floor(rest / 3600).cast("int"), F.floor(rest % 3600 / 60).cast("int"), (rest % 60).cast("int"), F.pmod(micros, F.lit(1_000_000))))
