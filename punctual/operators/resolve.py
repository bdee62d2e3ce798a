"""Resolve entities of one list to records of another by codes, names and a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.contracts import MAPPING_COLUMNS
from punctual.operators.join import match_candidates, name_match
from punctual.operators.project import project_contract

# fixed values: points of each reason, in the order they are listed
POINTS = {
    "icao_exact": 120, "icao_suffix": 100, "call_exact": 90, "name_code_match": 25, "aviation_name": 10,
    "state_match": 20, "us_station": 5, "has_period_of_record": 5, "begins_after_target": -500,
    "ends_before_target": -500, "active_in_target_period": 40, "has_noaa_data": 80, "no_noaa_data": -400,
}
POINTS_PER_YEAR = 20
AVIATION_WORDS = ("AIRPORT", "INTL", "FIELD")
HIGH, MEDIUM = 110, 70
HOME_COUNTRY = "US"


def score_match(
    entity: Column, region: Column, station: dict[str, Column], first_year: Column, last_year: Column, hits: Column
) -> tuple[Column, Column]:
    """(score, reasons) of a candidate.  Without target years only the first reasons count."""
    text = lambda c: F.coalesce(c, F.lit(""))
    icao, call, name = text(station["icao"]), text(station["call"]), F.upper(text(station["station_name"]))
    begin, end = F.year(station["begin_date"]), F.year(station["end_date"])
    targeted = first_year.isNotNull()
    starts_late = begin > last_year
    ended_early = end < first_year
    has_hits = F.coalesce(hits, F.lit(0)) > 0
    tests = {
        "icao_exact": icao == entity,
        "icao_suffix": (icao != entity) & (F.length(icao) == 4) & F.endswith(icao, entity),
        "call_exact": call == entity,
        "name_code_match": F.contains(name, entity),
        "aviation_name": F.contains(name, F.lit(AVIATION_WORDS[0]))
        | F.contains(name, F.lit(AVIATION_WORDS[1]))
        | F.contains(name, F.lit(AVIATION_WORDS[2])),
        "state_match": (region != "") & (region == text(station["state"])),
        "us_station": text(station["country"]) == HOME_COUNTRY,
        "has_period_of_record": station["end_date"].isNotNull(),
        "begins_after_target": targeted & starts_late,
        "ends_before_target": targeted & ended_early,
        "active_in_target_period": targeted
        & F.coalesce(~starts_late, F.lit(True))
        & F.coalesce(~ended_early, F.lit(True)),
        "has_noaa_data": targeted & has_hits,
        "no_noaa_data": targeted & ~has_hits,
    }
    sure = {n: F.coalesce(t, F.lit(False)) for n, t in tests.items()}
    score = F.lit(0.0)
    for n, t in sure.items():
        score = score + F.when(t, F.lit(float(POINTS[n]))).otherwise(0.0)
    score = score + F.when(sure["has_noaa_data"], POINTS_PER_YEAR * hits.cast("double")).otherwise(0.0)
    reasons = F.concat_ws(",", *[F.when(t, F.lit(n)) for n, t in sure.items()])
    return score, reasons


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def best_per_group(df: DataFrame, key: list[str], score: str, tie: str, prefer: Sequence[Column] = ()) -> DataFrame:
    """The best-scored row per key; ties go to the smaller tie value.

    ``prefer`` conditions come before the score, in their order: picking the best of the
    preferred rows if a key has any is the same as ordering by the condition first.  An
    aggregate, so candidates of a key collapse map-side.
    """
    rest = [c for c in df.columns if c not in key]
    flags = [F.when(F.coalesce(p, F.lit(False)), 0).otherwise(1).alias(f"__p{i}") for i, p in enumerate(prefer)]
    lead = F.struct(*flags, (-F.col(score)).alias("__s"), F.col(tie).alias("__t"))
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), lead).alias("__best"))
    return best.select(*key, "__best.*")


def resolve_entities(
    entities: DataFrame, stations: DataFrame, years: DataFrame, year_hits: DataFrame | None = None
) -> DataFrame:
    """The best station per (airport, state) in the mapping contract.

    ``years`` holds the target years, ``year_hits`` (station_id, year_hits) for how many of them
    a station has data.  Candidates come from codes, for entities without any from names; same
    state is preferred, then the home country.  Entities without candidates are kept as
    unmatched.  ``airport`` must be upper case and non-null.
    """
    key = ["airport", "state"]
    records = stations.select(
        "station_id", "station_name", "icao", "call", "country", "begin_date", "end_date", "latitude", "longitude",
        F.col("state").alias("station_state"),
    )
    # matched by ids alone; what the score needs of a station joins the pairs that were found
    by_code = match_candidates(entities.select(*key), records.select("station_id", "icao", "call")).select(*key, "station_id").distinct()
    unmatched = entities.select(*key).join(by_code, key, "left_anti")
    by_name = name_match(unmatched, records.select("station_id", "station_name")).select(*key, "station_id").distinct()
    candidates = by_code.unionByName(by_name).join(records, "station_id")
    if year_hits is None:
        candidates = candidates.withColumn("year_hits", F.lit(0).cast("bigint"))
    else:
        candidates = candidates.join(year_hits, "station_id", "left")
    span = years.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    candidates = candidates.withColumns({
        "first_year": span.select("first").scalar(), "last_year": span.select("last").scalar(),
    })
    station = {c: F.col(c) for c in ("icao", "call", "station_name", "country", "begin_date", "end_date")}
    station["state"] = F.col("station_state")
    score, details = score_match(
        F.col("airport"), F.col("state"), station, F.col("first_year"), F.col("last_year"), F.col("year_hits")
    )
    scored = candidates.select(
        *key, "station_id", "station_name", "latitude", "longitude",
        score.alias("confidence_score"), details.alias("match_details"),
        (F.col("station_state") == F.col("state")).alias("same_state"), (F.col("country") == HOME_COUNTRY).alias("at_home"),
    )
    best = best_per_group(
        scored, key, "confidence_score", "station_id", prefer=[F.col("same_state"), F.col("at_home")]
    ).drop("same_state", "at_home")
    level = confidence(F.col("confidence_score"))
    mapped = entities.select(*key).join(best, key, "left")
    found = F.col("confidence_score").isNotNull()
    mapped = mapped.withColumns({
        "mapping_confidence": F.when(found, level).otherwise("unmatched"),
        "distance_km": F.when(found & (level != "low"), F.lit(0.0)),
        "match_details": F.coalesce("match_details", F.lit("no_candidate_found")),
        "confidence_score": F.coalesce("confidence_score", F.lit(0.0)),
    })
    return project_contract(mapped, MAPPING_COLUMNS)
