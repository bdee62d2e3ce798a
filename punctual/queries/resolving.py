"""Entity resolution between a list of codes and a list of stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.operators import aggregate, join, resolve
from punctual.queries.registry import query
from punctual.queries.tables import STATIONS, station_list
from punctual.queries.views import table, with_views
from punctual.sources.stations import clean_stations

# (airport, state) pairs out of two column pairs, as trips have them
ENTITIES = """
entities AS (
  SELECT DISTINCT upper(airport) AS airport, upper(state) AS state FROM (
    SELECT chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || chr(CAST(65 + s_nationkey % 26 AS INTEGER)) AS airport, 's' || CAST(s_nationkey % 5 AS VARCHAR) AS state FROM supplier
    UNION ALL
    SELECT CASE WHEN p_partkey % 9 <> 0 THEN 'q' || chr(CAST(97 + p_partkey % 26 AS INTEGER)) || chr(CAST(97 + p_size % 26 AS INTEGER)) END, 'S' || CAST(p_size % 7 AS VARCHAR) FROM part
    UNION ALL
    SELECT CASE n_nationkey % 3 WHEN 0 THEN 'INTL' WHEN 1 THEN 'MUNI'
      ELSE CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'ZZ' END || CAST(n_nationkey AS VARCHAR) END, 'S1' FROM nation
  ) WHERE airport IS NOT NULL AND state IS NOT NULL
)"""


def entity_list(spark, sf_dir):
    char = lambda base, c: F.char(F.lit(base) + c % 26)
    supplier, part, nation = (table(spark, sf_dir, n) for n in ("supplier", "part", "nation"))
    a = supplier.select(
        F.concat(char(65, F.col("s_suppkey")), char(65, F.col("s_nationkey"))).alias("Origin"),
        F.concat(F.lit("s"), (F.col("s_nationkey") % 5).cast("string")).alias("OriginState"),
    )
    b = part.select(
        F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("q"), char(97, F.col("p_partkey")), char(97, F.col("p_size")))).alias("Dest"),
        F.concat(F.lit("S"), (F.col("p_size") % 7).cast("string")).alias("DestState"),
    )
    k = F.col("n_nationkey") % 3
    c = nation.select(
        F.when(k == 0, "INTL").when(k == 1, "MUNI").otherwise(
            F.concat(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("ZZ"), F.col("n_nationkey").cast("string"))
        ).alias("Origin"),
        F.lit("S1").alias("OriginState"),
    )
    both = join.union_all([a, b, c])
    return aggregate.distinct_entities(both, [("Origin", "OriginState"), ("Dest", "DestState")], ("airport", "state"))


@query("distinct_entities", with_views(ENTITIES) + "SELECT airport, state FROM entities")
def distinct_entities(spark, sf_dir):
    return entity_list(spark, sf_dir)


_BY_CODE = """
by_code AS (
  SELECT e.airport, e.state, s.* EXCLUDE (state), s.state AS station_state FROM entities e JOIN stations s
  ON s.icao = e.airport OR s.call = e.airport OR (length(s.icao) = 4 AND ends_with(s.icao, e.airport))
)"""
_BY_NAME = """
by_name AS (
  SELECT e.airport, e.state, s.* EXCLUDE (state), s.state AS station_state FROM entities e JOIN stations s
  ON regexp_matches(upper(s.station_name), '(^|[^A-Z])' || e.airport || '([^A-Z]|$)')
  WHERE NOT EXISTS (SELECT 1 FROM by_code b WHERE b.airport = e.airport AND b.state = e.state)
)"""


def _records(spark, sf_dir):
    return clean_stations(station_list(spark, sf_dir)).withColumnRenamed("state", "station_state")


@query("match_candidates", with_views(ENTITIES, STATIONS, _BY_CODE) + "SELECT DISTINCT airport, state, station_id FROM by_code")
def match_candidates(spark, sf_dir):
    pairs = join.match_candidates(entity_list(spark, sf_dir), _records(spark, sf_dir))
    return pairs.select("airport", "state", "station_id")


@query("name_fallback", with_views(ENTITIES, STATIONS, _BY_CODE, _BY_NAME) + """
SELECT airport, state, count(*) AS candidates, min(station_id) AS first_station FROM by_name GROUP BY 1, 2""")
def name_fallback(spark, sf_dir):
    entities, records = entity_list(spark, sf_dir), _records(spark, sf_dir)
    matched = join.match_candidates(entities, records).select("airport", "state").distinct()
    rest = entities.join(matched, ["airport", "state"], "left_anti")
    return join.name_match(rest, records).groupBy("airport", "state").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("station_id").alias("first_station")
    )


@query("preference_filter", with_views(ENTITIES, STATIONS, _BY_CODE) + """
, flagged AS (SELECT *, bool_or(station_state = state) OVER (PARTITION BY airport, state) AS has_state FROM by_code),
p AS (SELECT * FROM flagged WHERE NOT has_state OR station_state = state),
c AS (SELECT *, bool_or(country = 'US') OVER (PARTITION BY airport, state) AS has_us FROM p)
SELECT airport, state, station_id, station_state, country FROM c WHERE NOT has_us OR country = 'US'""")
def preference_filter(spark, sf_dir):
    pairs = join.match_candidates(entity_list(spark, sf_dir), _records(spark, sf_dir))
    key = ["airport", "state"]
    kept = aggregate.prefer_if_any(pairs, key, F.col("station_state") == F.col("state"))
    kept = aggregate.prefer_if_any(kept, key, F.col("country") == "US")
    return kept.select(*key, "station_id", "station_state", "country")


_HITS = """
target AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders),
span AS (SELECT min(year) AS lo, max(year) AS hi FROM target),
hits AS (
  SELECT st.station_id, count(DISTINCT year(l_shipdate)) AS year_hits
  FROM lineitem JOIN stations st ON l_partkey = st.k WHERE year(l_shipdate) IN (SELECT year FROM target) GROUP BY 1
)"""


def _years(spark, sf_dir):
    return aggregate.distinct_years(table(spark, sf_dir, "orders"), "o_orderdate")


def _hits(spark, sf_dir):
    """Years with data per station: lines stand for observations, their part for the station."""
    keyed = clean_stations(station_list(spark, sf_dir)).select(F.col("usaf"), "station_id")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("usaf"), "l_shipdate"
    )
    rows = lines.join(keyed, "usaf")
    return join.available_periods(rows, "station_id", "l_shipdate", _years(spark, sf_dir))


@query("availability", with_views(STATIONS, _HITS) + "SELECT station_id, year_hits FROM hits")
def availability(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("distinct_years", "SELECT DISTINCT year(o_orderdate) AS year FROM orders")
def distinct_years(spark, sf_dir):
    return _years(spark, sf_dir).select(F.col("year").cast("bigint").alias("year"))


_SCORED = """
scored AS (
  SELECT c.*, CAST(
      CASE WHEN icao = airport THEN 120 WHEN length(icao) = 4 AND ends_with(icao, airport) THEN 100 ELSE 0 END
    + CASE WHEN call = airport THEN 90 ELSE 0 END
    + CASE WHEN contains(upper(station_name), airport) THEN 25 ELSE 0 END
    + CASE WHEN contains(upper(station_name), 'AIRPORT') OR contains(upper(station_name), 'INTL') OR contains(upper(station_name), 'FIELD') THEN 10 ELSE 0 END
    + CASE WHEN state = station_state THEN 20 ELSE 0 END + CASE WHEN country = 'US' THEN 5 ELSE 0 END
    + CASE WHEN end_year IS NOT NULL THEN 5 ELSE 0 END
    - CASE WHEN begin_year > hi THEN 500 ELSE 0 END - CASE WHEN end_year < lo THEN 500 ELSE 0 END
    + CASE WHEN (begin_year IS NULL OR begin_year <= hi) AND (end_year IS NULL OR end_year >= lo) THEN 40 ELSE 0 END
    + CASE WHEN year_hits > 0 THEN 80 + 20 * year_hits ELSE -400 END AS DOUBLE) AS score,
    concat_ws(',', CASE WHEN icao = airport THEN 'icao_exact' WHEN length(icao) = 4 AND ends_with(icao, airport) THEN 'icao_suffix' END,
      CASE WHEN call = airport THEN 'call_exact' END, CASE WHEN contains(upper(station_name), airport) THEN 'name_code_match' END,
      CASE WHEN contains(upper(station_name), 'AIRPORT') OR contains(upper(station_name), 'INTL') OR contains(upper(station_name), 'FIELD') THEN 'aviation_name' END,
      CASE WHEN state = station_state THEN 'state_match' END, CASE WHEN country = 'US' THEN 'us_station' END,
      CASE WHEN end_year IS NOT NULL THEN 'has_period_of_record' END, CASE WHEN begin_year > hi THEN 'begins_after_target' END,
      CASE WHEN end_year < lo THEN 'ends_before_target' END,
      CASE WHEN (begin_year IS NULL OR begin_year <= hi) AND (end_year IS NULL OR end_year >= lo) THEN 'active_in_target_period' END,
      CASE WHEN year_hits > 0 THEN 'has_noaa_data' ELSE 'no_noaa_data' END) AS details
  FROM (SELECT * FROM by_code UNION ALL SELECT * FROM by_name) c LEFT JOIN hits USING (station_id) CROSS JOIN span
)"""


@query("match_score", with_views(ENTITIES, STATIONS, _BY_CODE, _BY_NAME, _HITS, _SCORED) + """
SELECT airport, state, station_id, score, details FROM scored""")
def match_score(spark, sf_dir):
    entities, records = entity_list(spark, sf_dir), _records(spark, sf_dir)
    by_code = join.match_candidates(entities, records)
    rest = entities.join(by_code.select("airport", "state").distinct(), ["airport", "state"], "left_anti")
    pairs = by_code.unionByName(join.name_match(rest, records)).join(_hits(spark, sf_dir), "station_id", "left")
    span = _years(spark, sf_dir).agg(F.min("year").alias("first"), F.max("year").alias("last"))
    pairs = pairs.withColumns({"first": span.select("first").scalar(), "last": span.select("last").scalar()})
    station = {c: F.col(c) for c in ("icao", "call", "station_name", "country", "begin_date", "end_date")}
    station["state"] = F.col("station_state")
    score, details = resolve.score_match(
        F.col("airport"), F.col("state"), station, F.col("first"), F.col("last"), F.col("year_hits")
    )
    return pairs.select("airport", "state", "station_id", score.alias("score"), details.alias("details"))


@query("resolve_entities", with_views(ENTITIES, STATIONS, _BY_CODE, _BY_NAME, _HITS, _SCORED) + """
, s1 AS (SELECT *, bool_or(station_state = state) OVER (PARTITION BY airport, state) AS has_state FROM scored),
s2 AS (SELECT *, bool_or(country = 'US') OVER (PARTITION BY airport, state) AS has_us FROM s1 WHERE NOT has_state OR station_state = state),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY airport, state ORDER BY score DESC, station_id) AS rn FROM s2 WHERE NOT has_us OR country = 'US') WHERE rn = 1)
SELECT airport, state, b.station_id, b.station_name, coalesce(b.score, 0) AS confidence_score,
       CASE WHEN b.score IS NULL THEN 'unmatched' WHEN b.score >= 110 THEN 'high' WHEN b.score >= 70 THEN 'medium' ELSE 'low' END AS mapping_confidence,
       CASE WHEN b.score >= 70 THEN 0.0 END AS distance_km, coalesce(b.details, 'no_candidate_found') AS match_details,
       b.latitude, b.longitude
FROM entities LEFT JOIN best b USING (airport, state)""")
def resolve_entities(spark, sf_dir):
    mapping = resolve.resolve_entities(
        entity_list(spark, sf_dir), clean_stations(station_list(spark, sf_dir)), _years(spark, sf_dir), _hits(spark, sf_dir)
    )
    return mapping.drop("timezone")


@query("best_per_group", """
SELECT s_nationkey, s_suppkey, s_name, s_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) WHERE rn = 1""")
def best_per_group(spark, sf_dir):
    return resolve.best_per_group(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")
