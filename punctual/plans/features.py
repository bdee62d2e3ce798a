"""Analysis frame, feature frame and the frames models train on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.contracts import ANALYSIS_COLUMNS, CATEGORICAL_FEATURES, NUMERIC_FEATURES
from punctual.functions.clock import is_peak_hour, is_us_federal_holiday, is_weekend, season_of_month
from punctual.functions.values import clip, interaction
from punctual.operators.aggregate import corrected_skewness
from punctual.operators.history import previous_period_features, prior_means
from punctual.operators.project import (
    coerce_numeric, fallback_columns, keep_top_entities, non_null_features, require_not_null,
)
from punctual.operators.split import sample_cap, temporal_split
from punctual.session import staged
from punctual.sources.tables import read_table_pruned

SKEW_LIMIT = 1.5
TIE_ORDER = ["Reporting_Airline", "Origin", "Dest", "Distance", "dep_delay_minutes"]


@dataclass
class FeatureFrame:
    frame: DataFrame
    categorical: list[str]
    numeric: list[str]
    notes: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numeric]


def analysis_frame(table: DataFrame) -> DataFrame:
    """A modelling table with stand-ins for absent columns, typed, rows without target left out."""
    kinds = dict(ANALYSIS_COLUMNS)
    df = fallback_columns(table)
    df = df.withColumns({
        "FlightDate": F.col("FlightDate").cast("date"), "sched_dep_utc": F.col("sched_dep_utc").cast("timestamp"),
    })
    df = coerce_numeric(df, [c for c, kind in kinds.items() if kind == "double"])
    df = require_not_null(df, ["FlightDate", "sched_dep_utc", "dep_delay_minutes", "dep_delayed_15"])
    return df.withColumns({
        "dep_delayed_15": F.col("dep_delayed_15").cast("int"),
        "dep_delay_minutes_late_only": clip(F.col("dep_delay_minutes"), low=0.0),
    })


def load_analysis_frame(spark: SparkSession, path: str) -> DataFrame:
    """Read only the columns the analysis needs."""
    return analysis_frame(read_table_pruned(spark, path, [c for c, _ in ANALYSIS_COLUMNS]))


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_weekend": is_weekend(F.col("day_of_week")),
        "peak_hour": is_peak_hour(F.col("scheduled_departure_hour_local")),
        "is_holiday": is_us_federal_holiday(F.col("FlightDate")),
        "season": season_of_month(F.col("month")),
    })


def build_feature_frame(
    frame: DataFrame, tie_order: Sequence[str] = TIE_ORDER, buckets: int | None = None
) -> FeatureFrame:
    """Calendar, previous-hour, prior-mean and interaction features."""
    df = previous_period_features(
        calendar_features(frame), "sched_dep_utc", "dep_delay_minutes", "dep_delayed_15",
        {"Origin": "origin", "Reporting_Airline": "carrier", "route": "route"}, rolling=("origin", "carrier"),
    )
    df = prior_means(
        df, "sched_dep_utc", "dep_delay_minutes",
        {"airport_carrier_avg_dep_delay_prior": ["Origin", "Reporting_Airline"]},
        [c for c in tie_order if c in df.columns], buckets=buckets, source=frame,
    )
    df = df.withColumn("origin_precip_mm", F.coalesce("origin_precip_mm", F.lit(0.0)))
    df = df.withColumn("precip_peak_interaction", interaction(F.col("origin_precip_mm"), F.col("peak_hour")))
    notes = [
        "Previous-hour features use the entity's last observed hour before the row's own.",
        "Three-hour rates average up to three observed hours before the row's own.",
        "Prior means use only earlier rows of the same keys.",
    ]
    return FeatureFrame(df, list(CATEGORICAL_FEATURES), list(NUMERIC_FEATURES), notes)


def log_candidates(train: DataFrame, columns: Sequence[str], limit: float = SKEW_LIMIT) -> DataFrame:
    """One row per column: least value, corrected skewness, and whether it gets a log twin."""
    c = lambda n: F.col(n).cast("double")
    wide = train.agg(*[F.struct(F.min(c(n)).alias("low"), corrected_skewness(c(n)).alias("skew")).alias(n) for n in columns])
    rows = [
        F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`.low").alias("low"), F.col(f"`{n}`.skew").alias("skew"))
        for n in columns
    ]
    long = wide.select(F.inline(F.array(*rows)))
    chosen = F.coalesce((F.col("low") >= 0) & (F.col("skew") >= limit), F.lit(False))
    return long.withColumn("selected", chosen.cast("int"))


def log1p_if_skewed(
    train: DataFrame, test: DataFrame, columns: Sequence[str], limit: float = SKEW_LIMIT
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Add ``log1p_x`` for non-negative, clearly skewed columns, chosen on train alone."""
    picked = {r["feature"] for r in log_candidates(train, columns, limit).where("selected = 1").collect()}
    chosen = [c for c in columns if c in picked]
    twin = lambda c: F.log1p(clip(F.col(c).cast("double"), low=0.0))
    add = {f"log1p_{c}": twin(c) for c in chosen}
    return train.withColumns(add), test.withColumns(add), list(add)


@dataclass
class ModelFrames:
    train: DataFrame
    test: DataFrame
    features: FeatureFrame
    cut: object


def build_model_frames(
    frame: DataFrame,
    top_origins: int = 0,
    train_cap: int | None = None,
    test_cap: int | None = None,
    identity: Sequence[str] = ("FlightDate", "Reporting_Airline", "Origin", "Dest", "sched_dep_utc"),
    tie_order: Sequence[str] = TIE_ORDER,
    stage: bool = True,
) -> ModelFrames:
    """Features on all rows, then the busiest origins, temporal split, log twins, live columns.

    The feature frame is written once to the shared folder (``stage``), since the split, the
    column checks and every model read it again.  Caps are off unless given.
    """
    built = build_feature_frame(frame, tie_order)
    df = keep_top_entities(built.frame, "Origin", top_origins)
    if stage:
        df = staged(df)
    train, test, cut = temporal_split(df, "FlightDate")
    train, test, logs = log1p_if_skewed(train, test, built.numeric)
    numeric = [*built.numeric, *logs]
    live = non_null_features(train, numeric)
    notes = list(built.notes)
    if logs:
        notes.append("log1p_ twins were chosen on the training rows only: " + ", ".join(logs))
    if len(live) < len(numeric):
        notes.append("Dropped without any value: " + ", ".join(c for c in numeric if c not in set(live)))
    if train_cap:
        train = sample_cap(train, train_cap, identity)
    if test_cap:
        test = sample_cap(test, test_cap, identity)
    return ModelFrames(train, test, FeatureFrame(df, built.categorical, live, notes), cut)
