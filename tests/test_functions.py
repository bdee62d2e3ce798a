from __future__ import annotations

import datetime as dt
import math

import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from punctual.functions import clock, values

X = F.col("x")


def test_hhmm(one):
    texts = [None, "", "nan", "5", "930", "0930.0", "2400", "2460", "2510", "12005", "ab", "  730 ", "-5", "24000"]
    assert one(texts, "string", clock.hhmm_to_minutes(X)) == [
        None, None, None, 5, 570, 570, 0, None, None, 725, None, 450, None, 0,
    ]


def test_local_to_utc_rules(one):
    local = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 00:30:00", "2024-11-03 02:30:00", "2024-07-01 12:00:00", None]
    utc = clock.local_to_utc(X.cast("timestamp_ntz"), F.lit("America/New_York"))
    got = one(local, "string", F.date_format(utc, "yyyy-MM-dd HH:mm"))
    assert got == ["2024-03-10 07:00", None, "2024-11-03 04:30", "2024-11-03 07:30", "2024-07-01 16:00", None]


@pytest.mark.parametrize("zone", ["America/New_York", "America/Los_Angeles", "America/Phoenix", "Pacific/Honolulu"])
def test_local_to_utc_equals_pandas(spark, zone):
    hours = pd.date_range("2023-03-11", "2023-03-13", freq="15min").append(pd.date_range("2023-11-04", "2023-11-06", freq="15min"))
    want = hours.tz_localize(zone, nonexistent="shift_forward", ambiguous="NaT").tz_convert("UTC")
    df = spark.createDataFrame([(i, str(h)) for i, h in enumerate(hours)], "i int, x string")
    utc = clock.local_to_utc(X.cast("timestamp_ntz"), F.lit(zone))
    got = [r[0] for r in df.orderBy("i").select(F.unix_seconds(utc)).collect()]
    assert got == [None if pd.isna(w) else int(w.timestamp()) for w in want]


@pytest.mark.parametrize(("zone", "days"), [
    ("Australia/Lord_Howe", ["2023-10-01", "2023-04-02"]), ("Pacific/Apia", ["2011-12-30", "2011-04-02"]), ("America/St_Johns", ["2005-04-03", "2005-10-30"]),
    ("Pacific/Chatham", ["2023-09-24", "2023-04-02"]), ("Asia/Kolkata", ["2023-01-01"]), ("Antarctica/Troll", ["2022-03-27", "2022-10-30"]),
])
def test_local_to_utc_of_odd_shifts(spark, zone, days):
    """Half an hour, two hours, a whole day, changes one minute after midnight.

    Of a skipped time the first instant after the gap is wanted (pandas goes to the next full hour).
    """
    hours = pd.DatetimeIndex([t for d in days for t in pd.date_range(pd.Timestamp(d) - pd.Timedelta("1D"), pd.Timestamp(d) + pd.Timedelta("2D"), freq="7min")])
    df = spark.createDataFrame([(i, str(h)) for i, h in enumerate(hours)], "i int, x string")
    utc = clock.local_to_utc(X.cast("timestamp_ntz"), F.lit(zone))
    got = [r[0] for r in df.orderBy("i").select(F.unix_seconds(utc)).collect()]
    for h, seconds in zip(hours, got, strict=True):
        around = pd.date_range(h - pd.Timedelta("1D"), h + pd.Timedelta("1D"), freq="min", tz="UTC")
        shown = around.tz_convert(zone).tz_localize(None)
        found = around[shown == h]
        want = found[0] if len(found) == 1 else None if len(found) else around[shown > h][0]
        assert seconds == (None if want is None else int(want.timestamp())), h


def test_holidays_equal_pandas(spark):
    days = pd.date_range("1980-01-01", "2035-12-31")
    holidays = set(USFederalHolidayCalendar().holidays(days[0], days[-1]))
    got = spark.range(len(days)).select(
        F.date_add(F.lit("1980-01-01").cast("date"), F.col("id").cast("int")).alias("d")
    ).where(clock.is_us_federal_holiday(F.col("d")) == 1)
    assert {pd.Timestamp(r["d"]) for r in got.collect()} == holidays


def test_calendar_parts(one):
    days = ["2024-01-01", "2024-01-06", "2024-01-07", None]
    assert one(days, "string", clock.weekday_number(X.cast("date"))) == [1, 6, 7, None]
    assert one([1, 6, 7, None], "int", clock.is_weekend(X)) == [0, 1, 1, 0]
    assert one([5, 6, 9, 10, None], "int", clock.is_peak_hour(X)) == [0, 1, 1, 0, 0]
    assert one([12, 2, 3, 6, 11, None], "int", clock.season_of_month(X)) == ["winter", "winter", "spring", "summer", "fall", None]


def test_months(spark):
    months = [tuple(r) for r in clock.month_sequence(spark, (2023, 11), (2024, 2)).collect()]
    assert months == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    assert clock.month_sequence(spark, (2024, 2), (2023, 11)).count() == 0


def test_threshold_and_numbers(one):
    assert one([15.0, 14.9, None, float("nan")], "double", values.threshold_label(X)) == [1, 0, 0, 0]
    assert one(["1.5", "x", None, "NaN"], "string", values.to_number(X)) == [1.5, None, None, None]
    assert one([-3.0, 5.0, 300.0, None], "double", values.clip(X, 0.0, 240.0)) == [0.0, 5.0, 240.0, None]


def test_compound(one):
    texts = ["+0056,1", "9999,9", "+9999,9", None, "-0012,1", "x,1"]
    assert one(texts, "string", values.compound_numeric(X, 0, 10.0)) == [5.6, None, None, None, -1.2, None]
    assert one(texts, "string", values.compound_numeric(X, 0, 10.0, reference_compat=True)) == [5.6, None, 999.9, None, -1.2, None]
    assert one(texts[:1], "string", values.compound_numeric(X, 4)) == [None]
    assert one([" a , b", None], "string", values.compound_text(X, 1)) == ["b", None]
    assert one(["a", None], "string", values.compound_text(X, 0, reference_compat=True)) == ["a", ""]


def test_humidity(one):
    got = one([20.0, None], "double", values.relative_humidity(X, F.lit(10.0)))
    want = 100 * math.exp(17.625 * 10 / 253.04) / math.exp(17.625 * 20 / 263.04)
    assert got[0] == pytest.approx(want) and got[1] is None


def test_buckets(one):
    got = one([0.0, 0.5, 1.0, 5.0, 10.0, 10.1, None, -1.0], "double", values.amount_bucket(X))
    assert got == ["0", "(0,1]", "(0,1]", "(1,5]", "(5,10]", "10+", "0", None]
    assert one([-5.0, 0.0, 3.9, 4.0, 240.0, 999.0], "double", values.equal_width_bin(X, 0, 240, 60)) == [0, 0, 0, 1, 59, 59]


def test_two_decimals_equals_python(one):
    numbers = [0.125, 2.675, 4.055, 1.005, -0.375, 12.0, 1e6 + 0.005, 0.0, 1.115, 107 / 40, 33 / 8, 2.5e-4, 99.995, -0.0, -0.001]
    numbers += [i / 200 for i in range(1, 400)] + [i * 0.0375 for i in range(200)] + [-i / 8 for i in range(1, 60)]
    assert one(numbers, "double", values.two_decimals(X)) == [f"{n:.2f}" for n in numbers]
    assert one([None], "double", values.two_decimals(X)) == ["NA"]


def test_labels_and_slugs(one):
    texts = ["ON_TIME", "DELAY", "on_time, not delay", "yes", "no", "x", "delay or on_time", None]
    assert one(texts, "string", values.parse_label(X)) == [0, 1, 0, 1, 0, None, 1, None]
    assert one(["Qwen/Two.5-7B!", "__a__"], "string", values.slugify(X)) == ["qwen_two_5_7b", "a"]


def test_row_text(spark):
    columns = [c for _, c in values.PROMPT_FIELDS]
    kinds = ", ".join(f"{c} double" for c in columns)
    row = ("JFK", "LAX", "AA", 7, *[1.0, None, 2.345, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0])
    df = spark.createDataFrame([row], f"Origin string, Dest string, Reporting_Airline string, scheduled_departure_hour_local int, {kinds}")
    text = df.select(values.row_text({})).first()[0]
    assert text.startswith("origin=JFK; dest=LAX; carrier=AA; dep_hour_local=7; distance_miles=1.00; origin_temp_c=NA; ")
    assert text.endswith("origin_congestion_proxy=9.00") and text.count("; ") == 13


def test_date_plus_minutes(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 75), (dt.date(2024, 1, 1), None)], "d date, m int")
    got = [r[0] for r in df.select(clock.date_plus_minutes(F.col("d"), F.col("m"))).collect()]
    assert got == [dt.datetime(2024, 1, 1, 1, 15), None]
