"""The four runs a user starts: dataset build, final models, supplement, row prompts.

Each takes paths, writes its tables below an output folder and returns them by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.contracts import FLIGHT_SORT, HEATMAP_COLUMNS, PROMPT_FIELDS
from punctual.functions.values import slugify
from punctual.learn import evaluate, importance, models, prep, smote, stats
from punctual.operators import aggregate, join, project, resolve, split
from punctual.plans import dataset, features, prompts, quality
from punctual.session import prepare, remove_staged, staged, staged_so_far
from punctual.sources import flights as flight_files
from punctual.sources import stations as station_files
from punctual.sources import tables, weather

LABEL, MINUTES, LATE = "dep_delayed_15", "dep_delay_minutes", "dep_delay_minutes_late_only"
IDENTITY = ["FlightDate", "sched_dep_utc", "Reporting_Airline", "Origin", "Dest"]


def _write(parts: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """Write each table below ``out`` and return it as read back."""
    written = {}
    for name, df in parts.items():
        path = f"{out.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        written[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return written


# --- dataset build --------------------------------------------------------------------------
def one_station_per_airport(mapping: DataFrame) -> DataFrame:
    """The best mapping of each airport, so that a join cannot multiply flights of an airport
    that occurs with two states."""
    return resolve.best_per_group(mapping, ["airport"], "confidence_score", "state")


def build_dataset(
    spark: SparkSession,
    flights_path: str | Sequence[str],
    weather_path: str,
    stations_path: str,
    zones: DataFrame,
    out: str,
    airlines: Sequence[str] = (),
    origins: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
    strict: bool = False,
    reference_compat: bool = False,
    multi_line: bool = True,
) -> dict[str, DataFrame]:
    """Landed files to modelling table, mapping, weather and quality report.

    ``zones`` holds (airport, timezone).  ``reference_compat`` keeps one mapping row per airport
    and state, and the quirks of the cleaning and previous-leg steps.
    """
    prepare(spark)
    flights = flight_files.read_flights(spark, flights_path, airlines, origins, start, end)
    flight_table = f"{out.rstrip('/')}/flights"
    tables.write_table(flights, flight_table, ["data_year", "data_month"], FLIGHT_SORT)
    flights = spark.read.parquet(flight_table)

    reports = weather.clean_weather(weather.read_weather_json(spark, weather_path, multi_line), reference_compat)
    reports = _write({"weather": reports}, out)["weather"]
    years = aggregate.distinct_years(flights, "FlightDate")
    entities = aggregate.distinct_entities(
        flights, [("Origin", "OriginState"), ("Dest", "DestState")], ("airport", "state")
    )
    hits = join.available_periods(reports, "station_id", "timestamp_utc", years)
    mapping = resolve.resolve_entities(entities, station_files.read_station_history(spark, stations_path), years, hits)
    mapping = mapping.drop("timezone").join(zones.select("airport", "timezone"), "airport", "left").select(*mapping.columns)
    mapping = _write({"mapping": mapping}, out)["mapping"]

    dimension = mapping if reference_compat else one_station_per_airport(mapping)
    modeling = dataset.build_modeling_table(
        flights, reports, dimension, strict=strict, reference_compat=reference_compat
    )
    modeling = _write({"modeling": modeling}, out)["modeling"]
    report = {f"quality_{n}": t for n, t in quality.quality_report(flights, mapping, reports, modeling).items()}
    return {"flights": flights, "weather": reports, "mapping": mapping, "modeling": modeling} | _write(report, out)


def _tidy(run):
    """What a run has staged goes when its tables are written."""

    @wraps(run)
    def wrapped(spark: SparkSession, *args, **more):
        mark = staged_so_far()
        out = run(spark, *args, **more)
        remove_staged(spark, mark)
        return out

    return wrapped


# --- final models -----------------------------------------------------------------------------
@_tidy
def final_models(
    spark: SparkSession,
    dataset_path: str,
    out: str,
    top_origins: int = 0,
    train_cap: int | None = None,
    test_cap: int | None = None,
    positions: DataFrame | None = None,
    settings: models.Settings | None = None,
) -> dict[str, DataFrame]:
    """Model comparison, thresholds, projection, regression, imbalance, ranking and the tables
    behind the figures.  All rows are used unless caps are given."""
    prepare(spark)
    loaded = features.load_analysis_frame(spark, dataset_path)
    got = features.build_model_frames(loaded, top_origins, train_cap, test_cap, IDENTITY)
    train, test = staged(got.train), staged(got.test)
    cats, nums = got.features.categorical, got.features.numeric
    book = prep.PrepBook(train, cats, nums)
    run = models.run_classification(train, test, cats, nums, LABEL, IDENTITY, settings=settings, book=book)
    best = run.predictions.where(F.col("model") == run.best)
    regression, _ = models.run_regression(train, test, cats, nums, LATE, IDENTITY, settings=settings, book=book)
    grow = lambda df: smote.smote_nc(df, [f"__n_{c}" for c in nums], [f"__o_{c}" for c in cats], LABEL, IDENTITY)
    known = {n: f for n, f in run.fitted.items() if n == "logistic_regression_balanced"}
    curve, loadings = prep.pca_report(train, nums, book)
    summary = quality.preprocessing_summary(train, test, got.features.features, nums)
    parts = {
        "model_metrics": run.metrics,
        "threshold_metrics": run.thresholds,
        "regression_metrics": regression,
        "best_models": evaluate.best_models(run.metrics, regression),
        "pca_comparison": models.run_pca_comparison(train, test, cats, nums, LABEL, IDENTITY, book, known),
        "pca_curve": curve,
        "pca_loadings": loadings,
        "imbalance_metrics": models.run_imbalance(
            train, test, cats, nums, LABEL, IDENTITY, grow, book, known.get("logistic_regression_balanced")
        ),
        "feature_ranking": prep.feature_ranking(train, cats, nums, LABEL, MINUTES, book),
        "delay_histogram": aggregate.histogram(train, LATE),
        "correlations": aggregate.pearson_matrix(train, HEATMAP_COLUMNS),
        "curve_points": evaluate.curve_points(best, ["model"]),
        "threshold_curve": evaluate.threshold_sweep(best, ["model"], evaluate.FINE_THRESHOLDS),
        "calibration": evaluate.calibration_table(best, ["model"]),
        "missing_features": summary["missing"],
        "skewed_features": summary["skewness"],
        "split_rows": summary["rows"],
    }
    chosen = run.fitted[run.best]
    if chosen.model is not None:
        parts["feature_importance"] = importance.model_importance(spark, chosen)
    if positions is not None:
        parts["busiest_places"] = join.attach_geo_topn(test, positions, "Origin", LABEL)
    if top_origins > 0:
        parts["reduction"] = reduction_table(spark, dataset_path, loaded, got.features.frame, top_origins)
    return _write(parts, out)


def reduction_table(
    spark: SparkSession, dataset_path: str, loaded: DataFrame, kept: DataFrame, top_origins: int
) -> DataFrame:
    """Rows at each stage from the stored table to the modelled subset."""
    count = F.count(F.lit(1)).alias("rows")
    stage = lambda i, name, df: df.agg(count).select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "rows")
    stages = join.union_all([
        stage(1, "stored_table", spark.read.parquet(dataset_path)),
        stage(2, "rows_with_target", loaded),
        stage(3, f"top_{top_origins}_origins", kept),
    ])
    return aggregate.stage_reduction(stages)


# --- supplement ---------------------------------------------------------------------------------
FOLD_METRICS = ["precision", "recall", "f1", "roc_auc", "pr_auc"]
PROFILE_MEANS = {
    "avg_delay_minutes": "dep_delay_minutes", "avg_precip_mm": "origin_precip_mm",
    "avg_visibility_m": "origin_visibility_m", "avg_ceiling_m": "origin_ceiling_m",
}


@_tidy
def supplement(
    spark: SparkSession,
    dataset_path: str,
    out: str,
    top_origins: int = 0,
    folds: int = 4,
    names: Sequence[str] = models.FOLD_CLASSIFIERS,
    settings: models.Settings | None = None,
    rounds: int = 999,
) -> dict[str, DataFrame]:
    """Descriptive rates, fold grid with group comparison, importance, entity clusters.

    The feature frame is built and written once and read by all of them.
    """
    prepare(spark)
    built = features.build_feature_frame(features.load_analysis_frame(spark, dataset_path))
    frame = staged(project.keep_top_entities(built.frame, "Origin", top_origins))
    cats, nums = built.categorical, project.non_null_features(frame, built.numeric)
    rate = lambda key, **kw: aggregate.rate_by(frame, key, LABEL, **kw)
    grid = staged(models.run_fold_grid(frame, "FlightDate", folds, cats, nums, LABEL, IDENTITY, names, settings))
    summary = aggregate.fold_summary(grid, FOLD_METRICS).orderBy(F.desc("pr_auc_mean"), "model")
    parts = {
        "dataset_summary": quality.dataset_summary(frame, "modelled_subset"),
        "feature_type_counts": quality.feature_type_counts(frame, cats, nums),
        "label_distribution": aggregate.value_counts(frame, LABEL),
        "rate_by_hour": rate("scheduled_departure_hour_local", keep_null=False),
        "rate_by_month": rate("month", keep_null=False),
        "rate_by_origin": aggregate.top_then_resort(rate("Origin")),
        "rate_by_carrier": aggregate.top_then_resort(rate("Reporting_Airline")),
        "rate_by_precipitation": aggregate.rate_by_bucket(frame, "origin_precip_mm", LABEL),
        "fold_metrics": grid,
        "model_summary": summary,
    }
    for metric in ("f1", "pr_auc", "roc_auc"):
        test, pairs = stats.significance(grid, "model", metric, ["model", "fold"], rounds)
        parts[f"anova_{metric}"], parts[f"pairwise_{metric}"] = test, pairs
    train, test_rows, _ = split.temporal_split(frame, "FlightDate")
    book = prep.PrepBook(train, cats, nums)
    for name in ("random_forest_balanced", "boosted_trees_classifier"):
        if name in names:
            fitted = models.fit_classifier(name, train, cats, nums, LABEL, settings, book)
            parts[f"importance_{name}"] = importance.model_importance(spark, fitted)
            parts[f"permutation_{name}"] = importance.permutation_importance(fitted, test_rows, IDENTITY)
    profile = aggregate.entity_profile(frame, "Origin", LABEL, PROFILE_MEANS)
    shape = ["delay_rate", *PROFILE_MEANS]
    clustered = staged(models.project_2d(models.cluster_profiles(profile, shape), shape))
    means = {"avg_delay_rate": "delay_rate", "avg_flights": "flights"} | {c: c for c in PROFILE_MEANS if c != "avg_delay_minutes"}
    parts["clusters"] = clustered
    parts["cluster_summary"] = aggregate.cluster_summary(clustered, means).orderBy("cluster")
    return _write(parts, out)


# --- row prompts --------------------------------------------------------------------------------
def row_prompts(
    spark: SparkSession, dataset_path: str, out: str, top_origins: int = 0, sample: int = 80, few_shot: int = 8
) -> DataFrame:
    """Prompts for a balanced sample of the test dates, to be answered by any text model."""
    prepare(spark)
    needed = ["FlightDate", LABEL, "Origin", "Dest", "Reporting_Airline"]
    wanted = [*needed, "scheduled_departure_hour_local", "sched_dep_utc", *[c for _, c in PROMPT_FIELDS]]
    df = project.coerce_numeric(tables.read_table_pruned(spark, dataset_path, wanted), [LABEL])
    df = project.require_not_null(df, needed).withColumn(LABEL, F.col(LABEL).cast("int"))
    df = project.keep_top_entities(df, "Origin", top_origins)
    return _write({"prompts": prompts.sampled_prompts(df, LABEL, IDENTITY, "FlightDate", sample, few_shot)}, out)["prompts"]


def score_row_answers(
    spark: SparkSession, answers: DataFrame, model: str, out: str, comparison: DataFrame | None = None,
    dataset_path: str | None = None, top_origins: int = 0, sample: int = 80, few_shot: int = 8,
) -> dict[str, DataFrame]:
    """Score answered prompts (column ``answer``) and put the model into the comparison table.

    The last four say how the prompts were made (as in ``row_prompts``) and stand beside the metrics.
    """
    parsed, metrics, confusion = prompts.score_answers(answers, "answer", LABEL)
    row = metrics.select(
        F.lit(model).alias("model"), slugify(F.lit(model)).alias("slug"),
        F.lit(dataset_path).cast("string").alias("dataset_path"), F.lit(top_origins).alias("top_origins"),
        F.lit(sample).alias("evaluation_rows_requested"), F.lit(few_shot).alias("few_shot_examples"), "*",
    )
    table = row if comparison is None else join.upsert_metrics(comparison, row)
    return _write({"answers": parsed, "answer_metrics": row, "answer_confusion": confusion, "answer_comparison": table}, out)
