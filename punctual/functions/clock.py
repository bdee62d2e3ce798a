"""Clock times, time zones and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hhmm_to_minutes(c: Column) -> Column:
    """Minutes after midnight of a clock text such as ``930`` or ``0930.0``; 2400 is 0.

    Text after the first two digits is the minute part whatever its length, so ``12005``
    is 12:05 while ``12345`` is null.
    """
    whole = F.substring_index(F.trim(c.cast("string")), ".", 1)
    padded = F.when(F.length(whole) < 4, F.lpad(whole, 4, "0")).otherwise(whole)
    digits = F.trim(c.cast("string")).rlike(r"^.") & padded.rlike(r"^[0-9]+$")
    hour = F.substring(padded, 1, 2).try_cast("int")
    minute = F.substring(padded, 3, 2147483647).try_cast("decimal(38,0)")
    valid = (hour <= 23) & (minute <= 59)
    return (
        F.when(digits & (hour == 24) & (minute == 0), F.lit(0))
        .when(digits & valid, hour * 60 + minute.try_cast("int"))
        .cast("int")
    )


def date_plus_minutes(day: Column, minutes: Column) -> Column:
    """Local wall-clock time (no zone) of a date and a minute offset."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def local_to_utc(local: Column, zone: Column) -> Column:
    """The instant of a local wall-clock time in a per-row zone, for clock changes of any size.

    The zone's offsets a day before and a day after tell what the clock may have shown: with one offset
    the instant follows, with two each is tried.  A time that occurs twice gives null.  A time that is skipped moves to
    the first valid instant after the gap, which is the change itself, found by halving to the second.
    Changes of a zone must be over two days apart.  The session zone must be UTC.
    """
    return instant_of(local, zone, *offsets_around(local, zone))


def offsets_around(local: Column, zone: Column) -> tuple[Column, Column]:
    """Seconds that the zone is ahead of UTC a day before and a day after a local time."""
    wall, day = local.cast("timestamp"), F.expr("INTERVAL 1 DAY")
    return _offset(wall - day, zone), _offset(wall + day, zone)


def _offset(t: Column, zone: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(t, zone)) - F.unix_seconds(t)


def instant_of(local: Column, zone: Column, before: Column, after: Column) -> Column:
    """``local_to_utc`` with the offsets around the time, which it uses many times: as columns they are looked up once."""
    wall = local.cast("timestamp")
    seconds = F.unix_seconds(wall)
    shown = lambda t: F.from_utc_timestamp(t, zone)
    less = lambda n: F.timestamp_micros(F.unix_micros(wall) - n * 1_000_000)
    first, second = less(before), less(after)
    fits = lambda t: shown(t) == wall

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("bigint")
        early = _offset(F.timestamp_seconds(middle), zone) == before
        return F.struct(F.when(early, middle).otherwise(s["low"]).alias("low"), F.when(early, s["high"]).otherwise(middle).alias("high"))

    # a change of up to a day is between them: 17 halvings
    span = F.struct((seconds - after).cast("bigint").alias("low"), (seconds - before).cast("bigint").alias("high"))
    change = F.timestamp_seconds(F.aggregate(F.sequence(F.lit(1), F.lit(17)), span, halved, lambda s: s["high"]))
    none = F.lit(None).cast("timestamp")
    return (
        F.when(before.isNull(), none).when(before == after, first)
        .when(fits(first) & fits(second), none).when(fits(first), first).when(fits(second), second).otherwise(change)
    )


def rolled_arrival(dep_utc: Column, arr_utc: Column, arr_local: Column, zone: Column) -> tuple[Column, Column]:
    """(local, UTC) arrival; one day later where it is over two hours before departure."""
    rolls = arr_utc < dep_utc - F.expr("INTERVAL 2 HOURS")
    next_day = arr_local + F.expr("INTERVAL 1 DAY")
    local = F.when(rolls, next_day).otherwise(arr_local)
    return local, F.when(rolls, local_to_utc(next_day, zone)).otherwise(arr_utc)


def hour_of_minutes(minutes: Column) -> Column:
    return F.floor(minutes / 60).cast("int")


def weekday_number(day: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(day) + 1


def floor_hour(t: Column) -> Column:
    return F.date_trunc("hour", t)


def is_weekend(weekday: Column) -> Column:
    return F.coalesce(weekday.isin(6, 7), F.lit(False)).cast("int")


def is_peak_hour(hour: Column) -> Column:
    """1 for hours 6 to 9, both included."""
    return F.coalesce(hour.between(6, 9), F.lit(False)).cast("int")


# fixed values: month numbers of each season
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}


def season_of_month(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), F.lit(name)).otherwise(out)
    return out


def route_key(origin: Column, dest: Column, missing: str | None = None) -> Column:
    """``origin_dest``; null if either is null unless a stand-in is given."""
    if missing is not None:
        origin, dest = F.coalesce(origin, F.lit(missing)), F.coalesce(dest, F.lit(missing))
    return F.concat(origin, F.lit("_"), dest)


def month_sequence(spark: SparkSession, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """One row (year, month) per month from start to end, both included; none if start is later."""
    first = F.make_date(F.lit(start[0]), F.lit(start[1]), F.lit(1))
    last = F.make_date(F.lit(end[0]), F.lit(end[1]), F.lit(1))
    months = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    return (
        spark.range(1)
        .select(F.explode(months).alias("m"))
        .select(F.year("m").alias("year"), F.month("m").alias("month"))
    )


# --- public holidays -----------------------------------------------------------------
def _nth_weekday(year: Column, month: int, weekday: str, nth: int) -> Column:
    before_first = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before_first, weekday), 7 * (nth - 1))


def _last_weekday(year: Column, month: int, weekday: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def _observed(day: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def us_federal_holidays(year: Column) -> Column:
    """Array of the observed US federal holidays that belong to a year.

    1 January on a Saturday is observed on 31 December of the year before.
    """
    on = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    fixed = [_observed(on(1, 1)), _observed(on(7, 4)), _observed(on(11, 11)), _observed(on(12, 25))]
    emancipation = _observed(on(6, 19))
    floating = [
        F.when(year >= 1986, _nth_weekday(year, 1, "Mon", 3)),
        _nth_weekday(year, 2, "Mon", 3),
        _last_weekday(year, 5, "Mon"),
        _nth_weekday(year, 9, "Mon", 1),
        _nth_weekday(year, 10, "Mon", 2),
        _nth_weekday(year, 11, "Thu", 4),
        F.when(emancipation >= F.lit("2021-06-18").cast("date"), emancipation),
    ]
    return F.array_compact(F.array(*fixed, *floating))


def is_us_federal_holiday(day: Column) -> Column:
    """1 on an observed US federal holiday, computed from the date alone (no table, no join)."""
    year = F.year(day)
    here = F.array_contains(us_federal_holidays(year), day)
    next_new_year = _observed(F.make_date(year + 1, F.lit(1), F.lit(1))) == day
    return F.coalesce(here | next_new_year, F.lit(False)).cast("int")
