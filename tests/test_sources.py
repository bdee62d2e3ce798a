from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from punctual.contracts import FLIGHT_SCHEMA, MAPPING_COLUMNS, MODEL_COLUMNS, WEATHER_COLUMNS
from punctual.operators.resolve import resolve_entities
from punctual.sources import flights, stations, tables, weather


def test_flight_files(spark, tmp_path):
    jan = "FlightDate,Reporting_Airline,Origin,Dest,DepDelay,Flight_Number_Reporting_Airline ,Extra\n2024-01-05, aa,jfk,LAX ,12.00,7,e\nbad,BB,SFO,LAX,x,8.0,\n"
    feb = "Origin,FlightDate,Reporting_Airline,Dest,DepDelay\nBOS,2024-02-01,AA,LAX,NaN\n"
    (tmp_path / "jan").mkdir()
    (tmp_path / "feb").mkdir()
    (tmp_path / "jan" / "on_time_2024_1.csv").write_text(jan)
    (tmp_path / "feb" / "on_time_2024_02.csv").write_text(feb)
    df = flights.read_flights(spark, [str(tmp_path / "jan"), str(tmp_path / "feb")])
    assert df.columns[:51] == FLIGHT_SCHEMA and {"Extra", "source_csv", "data_year", "data_month"} <= set(df.columns)
    rows = {r["Origin"]: r for r in df.collect()}
    assert (str(rows["JFK"]["FlightDate"]), rows["JFK"]["Reporting_Airline"], rows["JFK"]["Dest"]) == ("2024-01-05", "AA", "LAX")
    assert (rows["JFK"]["Flight_Number_Reporting_Airline"], rows["SFO"]["Flight_Number_Reporting_Airline"]) == (7, 8)
    assert rows["SFO"]["FlightDate"] is None and rows["SFO"]["DepDelay"] is None and rows["BOS"]["DepDelay"] is None
    assert (rows["JFK"]["data_year"], rows["JFK"]["data_month"], rows["BOS"]["data_month"]) == (2024, 1, 2)
    assert rows["BOS"]["source_csv"] == "on_time_2024_02.csv"
    only = flights.read_flights(spark, str(tmp_path / "jan"), airlines=["aa"], start="2024-01-05", end="2024-01-05")
    assert only.count() == 1


def test_archives(spark, tmp_path):
    for month in (1, 2):
        with zipfile.ZipFile(tmp_path / f"a_2024_{month}.zip", "w") as z:
            z.writestr(f"on_time_2024_{month}.csv", f"FlightDate,Origin\n2024-0{month}-01,JFK\n")
            z.writestr("readme.html", "x")
    out = tmp_path / "csv"
    done = flights.expand_archives(spark, str(tmp_path / "*.zip"), str(out)).collect()
    assert sorted(r["member"] for r in done) == ["a_2024_1-on_time_2024_1.csv", "a_2024_2-on_time_2024_2.csv"]
    df = flights.read_flights(spark, str(out))
    assert {(r["data_month"], str(r["FlightDate"])) for r in df.collect()} == {(1, "2024-01-01"), (2, "2024-02-01")}


def test_archive_with_two_tables_is_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.csv", "x\n")
        z.writestr("b.csv", "x\n")
    with pytest.raises(Exception, match="expected one CSV"):
        flights.expand_archives(spark, str(tmp_path / "bad.zip"), str(tmp_path / "out")).collect()


def report(**fields):
    base = {"STATION": "01001099999", "DATE": "2024-01-01T00:00:00", "TMP": "+0100,1", "DEW": "+0050,1"}
    return base | fields


def test_weather_json(spark, tmp_path):
    rows = [report(), report(TMP="+9999,9"), report(DATE="2024-01-01T01:00:00", AA1="01,9999,9", AA2="01,0025,1", AW2="61,1")]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text(json.dumps([report(STATION="2", DATE="nonsense")]))
    raw = weather.read_weather_json(spark, str(tmp_path))
    assert {r["STATION"] for r in raw.collect()} == {"01001099999", "2"}
    clean = weather.clean_weather(raw)
    assert clean.columns == [c for c, _ in WEATHER_COLUMNS]
    got = {r["timestamp_utc"].hour: r for r in clean.collect()}
    assert set(got) == {0, 1} and got[1]["precip_mm"] == 2.5 and got[1]["weather_code"] == "61"
    assert got[0]["temperature_c"] in (10.0, None) and got[1]["relative_humidity_pct"] == pytest.approx(71.02, abs=0.1)
    compat = {r["timestamp_utc"].hour: r for r in weather.clean_weather(raw, reference_compat=True).collect()}
    assert compat[1]["precip_mm"] == 2.5 and compat[1]["weather_code"] == ""


def test_weather_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps([report(DATE=f"2024-01-01T0{h}:00:00")]) for h in range(3)))
    assert weather.read_weather_json(spark, str(tmp_path), multi_line=False).count() == 3


STATIONS = (
    "USAF,WBAN,STATION NAME,CTRY,STATE,ICAO,CALL,LAT,LON,ELEV(M),BEGIN,END\n"
    "744860,94789,JFK INTL AIRPORT,US,NY,KJFK,KJFK,40.6,-73.7,3,19730101,20251231\n"
    "12,5,OLD JFK FIELD,US,NJ,KJFK,,40.0,-73.0,3,19300101,19501231\n"
    "723030,00001,HARBOR XYZ PIER,CA,ON,,,45.0,-75.0,3,20000101,20251231\n"
    "7654321,00001,TOO LONG ABC,US,NY,KABC,,45.0,-75.0,3,20000101,20251231\n"
)


def test_station_history_and_resolution(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text(STATIONS)
    df = stations.read_station_history(spark, str(path))
    rows = {r["station_id"]: r for r in df.collect()}
    assert set(rows) == {"74486094789", "00001200005", "72303000001"}
    assert str(rows["74486094789"]["begin_date"]) == "1973-01-01" and rows["74486094789"]["latitude"] == 40.6
    entities = spark.createDataFrame([("JFK", "NY"), ("JFK", "NJ"), ("XYZ", "ON"), ("QQQ", "TX")], "airport string, state string")
    years = spark.createDataFrame([(2024,), (2025,)], "year int")
    hits = spark.createDataFrame([("74486094789", 2), ("72303000001", 1)], "station_id string, year_hits bigint")
    out = resolve_entities(entities, df, years, hits)
    assert out.columns == [c for c, _ in MAPPING_COLUMNS]
    got = {(r["airport"], r["state"]): r for r in out.collect()}
    best = got["JFK", "NY"]
    # 100 suffix, 25 name, 10 aviation, 20 state, 5 country, 5 record, 40 active, 80 + 40 data
    assert (best["station_id"], best["confidence_score"], best["mapping_confidence"]) == ("74486094789", 325.0, "high")
    assert best["match_details"] == "icao_suffix,name_code_match,aviation_name,state_match,us_station,has_period_of_record,active_in_target_period,has_noaa_data"
    other = got["JFK", "NJ"]
    assert other["station_id"] == "00001200005" and other["mapping_confidence"] == "low" and other["distance_km"] is None
    assert got["XYZ", "ON"]["station_id"] == "72303000001" and got["XYZ", "ON"]["mapping_confidence"] == "high"
    none = got["QQQ", "TX"]
    assert (none["station_id"], none["mapping_confidence"], none["confidence_score"], none["match_details"]) == (None, "unmatched", 0.0, "no_candidate_found")


def test_tables(spark, tmp_path):
    df = spark.range(100).withColumns({"year": F.lit(2024), "month": (F.col("id") % 2 + 1).cast("int")})
    path = tables.write_table(df, str(tmp_path / "t"), ["year", "month"], ["id"])
    assert tables.read_table_pruned(spark, path, ["month", "id", "absent"]).columns == ["month", "id"]
    built = []
    build = lambda: built.append(1) or df
    part = str(tmp_path / "part")
    assert tables.cached_partition(spark, part, build, F.col("id") < 10).count() == 10
    assert tables.cached_partition(spark, part, build, F.col("id") >= 10).count() == 90
    assert len(built) == 1
    tables.cached_partition(spark, part, build, overwrite=True)
    assert len(built) == 2
    metrics = spark.createDataFrame([("m", 0.5)], "model string, f1 double")
    back = tables.read_metrics(spark, tables.write_metrics(metrics, str(tmp_path / "m")), "model string, f1 double")
    assert back.collect() == metrics.collect()


def test_contract_sizes():
    assert (len(FLIGHT_SCHEMA), len(WEATHER_COLUMNS), len(MAPPING_COLUMNS), len(MODEL_COLUMNS)) == (51, 18, 11, 52)
