"""Mixed timestamp notations and zones, normalised to one UTC instant.

Every text is reduced to a *wall clock* (microseconds, as if UTC) and one of three statements about its
offset: a stated offset, a zone abbreviation, or none. For a text without offset the offsets that the
zone's history holds around that wall clock are the candidates; a candidate *violates* the history when the
instant it leads to did not have that offset. The candidates without violation decide:
one -> ``instant``, two -> ``ambiguous``, none -> ``nonexistent``.

Rows whose zone is not stated use ``default_zone``; :func:`estimate_zones` estimates the zone of a sensor from the
alignment of its wall clocks with the ingestion times, and :func:`fill_zones` puts the estimates where a zone is missing.

Everything stays in JVM expressions; reading a text needs no shuffle and no Python per row.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.operators.scan import same_keys

BLANKS = " \t\n\r\f\u000b "
DAY_US = 86_400_000_000
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\z"

_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s?(?:[Zz]|[+-]\d{2}:?(?:\d{2})?|[A-Za-z]{2,5})?\z"
_EPOCH = r"^\d{9,17}(?:\.\d+)?\z"
_COMPACT = r"^\d{8}[Tt ]\d{6}(?:[.,]\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?\z"
_CLF = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{2}:?\d{2})?\z"
_RFC = r"^(?:[A-Za-z]{3}, )?\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}(?: (?:[+-]\d{2}:?\d{2}|[A-Za-z]{1,5}))?\z"
_ASC = r"^[A-Za-z]{3} [A-Za-z]{3} {1,2}\d{1,2} \d{2}:\d{2}:\d{2} \d{4}\z"
_SLASH = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}(?: [AaPp][Mm])?\z"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


@functools.lru_cache(maxsize=1)
def _abbreviations() -> tuple[dict[str, int], dict[str, int], tuple[str, ...]]:
    """Offsets in seconds by abbreviation, and by zone and abbreviation where zones differ; all zone names.

    Built from the public zone database, from each zone's winter and summer of 1990 to 2037.
    """
    seen: dict[str, dict[str, set[int]]] = {}
    zones = tuple(sorted(zoneinfo.available_timezones()))
    for name in zones:
        try:
            zone = zoneinfo.ZoneInfo(name)
        except Exception:  # noqa: BLE001 - a damaged entry of the database
            continue
        for year in range(1990, 2038, 3):
            for month in (1, 7):
                at = dt.datetime(year, month, 1, 12, tzinfo=dt.UTC).astimezone(zone)
                abbreviation = at.tzname() or ""
                if abbreviation.isalpha():
                    seen.setdefault(abbreviation.upper(), {}).setdefault(name, set()).add(int(at.utcoffset().total_seconds()))
    plain: dict[str, int] = {"UTC": 0, "GMT": 0, "UT": 0, "Z": 0}
    zoned: dict[str, int] = {}
    for abbreviation, by_zone in seen.items():
        offsets = set().union(*by_zone.values())
        if abbreviation in plain:
            continue
        if len(offsets) == 1:
            plain[abbreviation] = offsets.pop()
        else:
            zoned.update({f"{zone}|{abbreviation}": min(o) for zone, o in by_zone.items() if len(o) == 1})
    return plain, zoned, zones


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in sorted(pairs.items()))), F.lit(","), F.lit("="))


def _two(text: Column, at: int) -> Column:
    return F.substring(text, at, 2)


def offset_us(us: Column, zone: Column) -> Column:
    """The zone's offset, in microseconds, at the UTC instant ``us``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def _month_number(text: Column) -> Column:
    at = F.call_function("instr", F.lit(_MONTHS), F.lower(text))
    return F.when((at > 0) & (at % 3 == 1), F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0")).otherwise("00")


def normalise_times(
    df: DataFrame,
    text: str,
    zone: str,
    outcome: str = "outcome",
    instant: str = "instant_us",
    default_zone: str = "UTC",
) -> DataFrame:
    """Add ``outcome`` and ``instant`` (long, microseconds since 1970 UTC) of the text column ``text``.

    * ``outcome`` is null where the text is null or blank; else ``instant``, ``ambiguous``, ``nonexistent``
      or ``unreadable``. ``instant`` is 0 unless the outcome is ``instant`` (null where the outcome is null).
    * A null or blank zone is ``default_zone``; an unknown zone name makes texts that need it unreadable.
    * Digits finer than a microsecond are cut. Bare numbers are seconds, milliseconds or microseconds by size.
    * Day and month separated by slashes: the order that gives a valid date; unreadable if both do and differ.

    Columns of ``df`` keep their values; columns named like the two results are replaced.
    """
    plain, zoned, zones = _abbreviations()
    keep = [c for c in df.columns if c not in (outcome, instant)]
    raw = df[text].cast("string")
    tz = F.trim(F.coalesce(df[zone].cast("string"), F.lit("")), F.lit(BLANKS))
    out = df.select(
        *[df[c] for c in keep],
        F.trim(raw, F.lit(BLANKS)).alias("__t"),
        F.when(tz == "", F.lit(default_zone)).otherwise(tz).alias("__tz"),
    )
    t = F.col("__t")
    kind = (
        F.when(t.rlike(CANONICAL), 8).when(t.rlike(_ISO), 1).when(t.rlike(_EPOCH), 2).when(t.rlike(_COMPACT), 3).when(t.rlike(_CLF), 4)
        .when(t.rlike(_RFC), 5).when(t.rlike(_ASC), 6).when(t.rlike(_SLASH), 7).otherwise(0)
    )
    out = out.withColumn("__kind", kind)
    k = F.col("__kind")

    # The date and time as 'yyyy-MM-dd HH:mm:ss', and what follows it (fraction and zone).
    rfc = F.regexp_replace(t, r"^[A-Za-z]{3}, ", "")
    rfc = F.when(F.substring(rfc, 2, 1) == " ", F.concat(F.lit("0"), rfc)).otherwise(rfc)
    clf = F.when(F.substring(t, 2, 1) == "/", F.concat(F.lit("0"), t)).otherwise(t)
    asc = F.regexp_replace(t, " {2,}", " ")
    asc_day = F.split_part(asc, F.lit(" "), F.lit(3))
    slash_date = F.split_part(t, F.lit(" "), F.lit(1))
    slash_clock = F.lpad(F.split_part(t, F.lit(" "), F.lit(2)), 8, "0")
    hour = F.substring(slash_clock, 1, 2).cast("int")
    half = F.upper(F.split_part(t, F.lit(" "), F.lit(3)))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0)).otherwise(99)
    slash_time = F.concat(F.lpad(hour24.cast("string"), 2, "0"), F.substring(slash_clock, 3, 6))
    first, second = (F.lpad(F.split_part(slash_date, F.lit("/"), F.lit(i)), 2, "0") for i in (1, 2))
    year = F.split_part(slash_date, F.lit("/"), F.lit(3))
    day_first = F.concat(year, F.lit("-"), second, F.lit("-"), first)
    month_first = F.concat(year, F.lit("-"), first, F.lit("-"), second)
    day_ok = second <= "12"
    month_ok = first <= "12"
    slash = (
        F.when(day_ok & month_ok & (first != second), F.lit("none"))
        .otherwise(F.concat(F.when(day_ok, day_first).otherwise(month_first), F.lit(" "), slash_time))
    )
    dash = F.lit("-")
    base = (
        F.when(k == 1, F.concat(F.substring(t, 1, 10), F.lit(" "), F.substring(t, 12, 8)))
        .when(k == 3, F.concat(F.substring(t, 1, 4), dash, _two(t, 5), dash, _two(t, 7), F.lit(" "), _two(t, 10), F.lit(":"), _two(t, 12), F.lit(":"), _two(t, 14)))
        .when(k == 4, F.concat(F.substring(clf, 8, 4), dash, _month_number(F.substring(clf, 4, 3)), dash, _two(clf, 1), F.lit(" "), F.substring(clf, 13, 8)))
        .when(k == 5, F.concat(F.substring(rfc, 8, 4), dash, _month_number(F.substring(rfc, 4, 3)), dash, _two(rfc, 1), F.lit(" "), F.substring(rfc, 13, 8)))
        .when(k == 6, F.concat(F.substring_index(asc, " ", -1), dash, _month_number(F.substring(asc, 5, 3)), dash, F.lpad(asc_day, 2, "0"), F.lit(" "), F.split_part(asc, F.lit(" "), F.lit(4))))
        .when(k == 7, slash)
    )
    rest = (
        F.when(k == 1, F.substring(t, 20, 64)).when(k == 3, F.substring(t, 16, 64))
        .when(k == 4, F.substring(clf, 21, 64)).when(k == 5, F.substring(rfc, 21, 64)).otherwise("")
    )
    out = out.withColumns({"__rest": rest, "__wall": F.unix_micros(F.concat(base, F.lit("Z")).try_cast("timestamp"))})
    rest = F.col("__rest")
    simple = rest.isin("", "Z", "z")
    zone_text = F.upper(F.when(simple, rest).otherwise(F.regexp_extract(rest, r"^(?:[.,]\d+)?\s?(.*)\z", 1)))
    digits = F.when(simple, "").otherwise(F.regexp_extract(rest, r"^[.,](\d+)", 1))
    fraction = F.when(digits == "", F.lit(0)).otherwise(F.rpad(F.substring(digits, 1, 6), 6, "0").cast("long"))
    out = out.withColumns({"__zone": zone_text, "__wall": F.col("__wall") + fraction})

    z, tz, wall = F.col("__zone"), F.col("__tz"), F.col("__wall")
    bare = F.regexp_replace(z, "[+:-]", "")
    hh, mm = F.substring(bare, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(bare, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    numeric = F.when((hh <= 18) & (mm <= 59), sign * (hh * 3600 + mm * 60))
    named = F.coalesce(F.element_at(_literal_map(plain), z), F.element_at(_literal_map(zoned), F.concat(tz, F.lit("|"), z))).try_cast("int")
    stated = F.when(z == "Z", F.lit(0)).when(z.rlike("^[+-]"), numeric).when(z != "", named)
    whole = F.split_part(t, F.lit("."), F.lit(1)).try_cast("long")
    part = F.when(F.instr(t, ".") > 0, F.rpad(F.substring(F.split_part(t, F.lit("."), F.lit(2)), 1, 6), 6, "0").try_cast("long")).otherwise(F.lit(0))
    epoch = (
        F.when(whole < 100_000_000_000, whole * 1_000_000 + part)
        .when(whole < 100_000_000_000_000, whole * 1000 + F.floor(part / 1000))
        .otherwise(whole)
    )
    local = (k != 2) & wall.isNotNull() & (z == "")
    known = tz.isin(list(zones))
    # the two offsets that bracket the wall clock; they differ only near a change of the zone's offset
    before = F.when(local & (tz == "UTC"), F.lit(0)).when(local & known, offset_us(wall - DAY_US, tz))
    after = F.when(local & (tz == "UTC"), F.lit(0)).when(local & known, offset_us(wall + DAY_US, tz))
    out = out.withColumns({
        "__before": before,
        "__after": after,
        "__fixed": F.when(k == 8, F.unix_micros(t.try_cast("timestamp"))).when(k == 2, epoch).when(wall.isNotNull() & (z != ""), wall - stated.cast("long") * 1_000_000),
    })
    before, after, fixed = F.col("__before"), F.col("__after"), F.col("__fixed")
    changes = before != after
    fits_before = F.when(changes, offset_us(wall - before, tz) == before).otherwise(before.isNotNull())
    fits_after = F.when(changes, offset_us(wall - after, tz) == after).otherwise(F.lit(False))
    out = out.withColumns({"__fb": fits_before, "__fa": fits_after})
    fb, fa = F.col("__fb"), F.col("__fa")
    result = (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(fixed.isNotNull(), "instant")
        .when(before.isNull(), "unreadable")
        .when(fb & fa, "ambiguous")
        .when(fb | fa, "instant")
        .otherwise("nonexistent")
    )
    us = F.when(fixed.isNotNull(), fixed).when(fb & fa, 0).when(fb, wall - before).when(fa, wall - after).otherwise(0)
    # a generator, so that a filter on the results is not pushed down as a copy of all the expressions above
    both = F.struct(result.alias(outcome), F.when(t.isNotNull() & (t != ""), us).cast("long").alias(instant))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(both)))


def is_canonical(text: Column, outcome: Column) -> Column:
    """Whether a stored text already is a valid ``yyyy-MM-ddTHH:mm:ss[.digits]Z``."""
    return text.rlike(CANONICAL) & (outcome == "instant")


def is_wall_clock(text: Column) -> Column:
    """Whether a text is a date and time of a known notation without zone and without offset."""
    t = F.trim(text, F.lit(BLANKS))
    bare = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\z|^\d{8}[Tt ]\d{6}(?:[.,]\d+)?\z|^\d{1,2}/[A-Za-z]{3}/\d{4}:[\d:]{8}\z"
    named = r"^(?:[A-Za-z]{3}, )?\d{1,2} [A-Za-z]{3} \d{4} [\d:]{8}\z"
    return t.rlike(f"{bare}|{named}|{_ASC}|{_SLASH}")


def lacks_zone(zone: Column) -> Column:
    return F.trim(F.coalesce(zone.cast("string"), F.lit("")), F.lit(BLANKS)) == ""


def stated_zones(df: DataFrame, zone: str) -> list[str]:
    """The zones that the rows name, in order; at most as many as the zone database has."""
    known = _abbreviations()[2]
    rows = df.select(F.trim(F.col(zone).cast("string"), F.lit(BLANKS)).alias("z")).where(F.col("z").isin(list(known))).distinct()
    return sorted(r["z"] for r in rows.collect())


def estimate_zones(
    df: DataFrame,
    sensor: list[str],
    text: str,
    received: str,
    candidates: list[str],
    max_lag_s: int = 6 * 3600,
    prior: str | None = None,
    evidence: int = 8,
) -> DataFrame:
    """Estimate the zone of each sensor from its zone-less wall clocks and ingestion times.

    Every candidate zone's offset history turns a wall clock into an instant; it *violates* the alignment when
    that instant lies after the ingestion or more than ``max_lag_s`` before it, or never existed. The zone with
    the fewest violations wins, then the smallest mean lag, then the one whose offset changed least over the
    sensor's texts and whose database entry knows no summer time, then the name. A ``prior`` zone stays unless at
    least ``evidence`` and more than half of the sensor's texts violate it and at most half violate the winner: late rows
    and few texts do not overrule it. One row per sensor: its columns and ``zone, n, violations, mean_lag_s``. Sensors without any such text
    have no row; null sensors are one group; rows without ingestion time do not count.

    Each text is read once; the candidates are at most the zones of the database, so the expansion is a constant
    factor, and its counts are added up before the shuffle.
    """
    names = [f"__s{i}" for i in range(len(sensor))]
    base = df.where(is_wall_clock(F.col(text)) & F.col(received).isNotNull()).select(
        *[F.col(c).alias(n) for c, n in zip(sensor, names, strict=True)], F.col(text).alias("__text"), F.lit("UTC").alias("__utc"), F.unix_micros(F.col(received).cast("timestamp")).alias("__got"),
    )
    walls = normalise_times(base, "__text", "__utc", "__outcome", "__wall").where(F.col("__outcome") == "instant")
    choice = [F.struct(F.lit(c).alias("zone"), F.lit(int(_has_summer_time(c))).alias("summer")) for c in sorted({*candidates, *([prior] if prior else [])})]
    tried = walls.select(*names, "__got", "__wall", F.explode(F.array(*choice)).alias("c"))
    instant = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__wall"), F.col("c.zone")))
    tried = tried.select(*names, "__got", "__wall", F.col("c.zone").alias("zone"), F.col("c.summer").alias("summer"), instant.alias("__us"))
    offset = F.col("__wall") - F.col("__us")
    exists = offset_us(F.col("__us"), F.col("zone")) == offset
    lag = F.col("__got") - F.col("__us")
    fine = exists & lag.between(0, max_lag_s * 1_000_000)
    scored = tried.groupBy(*names, "zone", "summer").agg(
        F.count("*").alias("n"), F.sum(F.when(fine, 0).otherwise(1)).alias("violations"), F.sum(F.when(fine, lag)).alias("lags"),
        F.min(offset).alias("least"), F.max(offset).alias("most"),
    )
    mean = F.round(F.col("lags") / (F.col("n") - F.col("violations")) / 1e6, 3)
    scored = scored.withColumn("mean_lag_s", mean)
    order = F.struct("violations", F.coalesce("mean_lag_s", F.lit(float("inf"))).alias("m"), (F.col("least") != F.col("most")).cast("int").alias("changes"), "summer", "zone", "n", "mean_lag_s")
    best = scored.groupBy(*names).agg(F.min(order).alias("b"), F.min(F.when(F.col("zone") == (prior or ""), order)).alias("p"))
    stays = F.col("p").isNotNull() & ~((F.col("p.violations") >= evidence) & (F.col("p.violations") * 2 > F.col("p.n")) & (F.col("b.violations") * 2 <= F.col("b.n")))
    won = best.withColumn("w", F.when(stays, F.col("p")).otherwise(F.col("b")))
    return won.select(*[F.col(n).alias(c) for n, c in zip(names, sensor, strict=True)], "w.zone", "w.n", "w.violations", "w.mean_lag_s")


@functools.lru_cache(maxsize=1024)
def _has_summer_time(zone: str) -> bool:
    z = zoneinfo.ZoneInfo(zone)
    return len({dt.datetime(2024, m, 1, tzinfo=z).utcoffset() for m in (1, 7)}) > 1


def fill_zones(df: DataFrame, sensor: list[str], text: str, zone: str, received: str, candidates: list[str], default_zone: str = "UTC", max_lag_s: int = 6 * 3600) -> DataFrame:
    """``df`` with a zone in every row: the stated one, else the sensor's estimate with ``default_zone`` as prior.

    Only sensors whose estimate differs from the default are joined; the rows of a hot sensor stay where they are as long as
    those are few, which AQE sees at run time.
    """
    lacking = df.where(lacks_zone(F.col(zone)))
    other = estimate_zones(lacking, sensor, text, received, candidates, max_lag_s, default_zone).where(F.col("zone") != default_zone)
    other = other.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(sensor)], F.col("zone").alias("__zone"))
    keyed = other.toDF(*sensor, "__zone")
    joined = df.join(keyed, same_keys(df, keyed, sensor) & lacks_zone(df[zone]), "left")
    filled = F.when(~lacks_zone(df[zone]), df[zone]).otherwise(F.coalesce(keyed["__zone"], F.lit(default_zone)))
    return joined.select(*[filled.alias(zone) if c == zone else df[c] for c in df.columns])
