"""The four runs end to end on files made from the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from punctual.learn.models import Settings
from punctual.plans import runs
from punctual.queries import pipeline
from punctual.queries.views import obs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
LIGHT = Settings(trees=3, tree_depth=3, rounds=2, boost_depth=2, net_iterations=5)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    flights = pipeline.flights(spark, SF)
    state = lambda c: F.concat(F.lit("S"), (F.substring(c, 2, 2).cast("int") % 3).cast("string"))
    clock = lambda h: F.lpad((h % 24).cast("string"), 2, "0")
    k = F.col("Flight_Number_Reporting_Airline")
    files = flights.withColumns({
        "OriginState": state(F.col("Origin")), "DestState": state(F.col("Dest")),
        "CRSDepTime": F.concat(clock(k), F.lit("15")), "CRSArrTime": F.concat(clock(k + 2), F.lit("45")),
    })
    files.coalesce(1).write.option("header", True).csv(str(root / "flights"))
    reports = obs(spark, SF).select(
        F.concat(F.lit("0"), F.lpad(F.substring("station", 2, 2), 10, "0")).alias("STATION"),
        F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("DATE"), F.lit("FM-15").alias("REPORT_TYPE"),
        F.lit("+0100,1").alias("TMP"), F.lit("+0050,1").alias("DEW"),
        F.concat(F.lit("01,"), F.lpad((F.col("obs_id") % 120).cast("string"), 4, "0")).alias("AA1"),
        F.concat(F.lpad((F.col("obs_id") % 9000).cast("string"), 6, "0"), F.lit(",1")).alias("VIS"),
    )
    reports.write.json(str(root / "weather"))
    lines = ["USAF,WBAN,STATION NAME,CTRY,STATE,ICAO,CALL,LAT,LON,ELEV(M),BEGIN,END"]
    lines += [f"0{'0' * 3}00,{n:05d},FIELD A{n:02d} AIRPORT,US,S{n % 3},KA{n:02d},A{n:02d},40,-70,1,20000101,20301231" for n in range(30)]
    (root / "stations.csv").write_text("\n".join(lines) + "\n")
    zones = spark.createDataFrame([(f"A{n:02d}", "America/Chicago") for n in range(30)], "airport string, timezone string")
    out = runs.build_dataset(
        spark, str(root / "flights"), str(root / "weather"), str(root / "stations.csv"), zones, str(root / "out"), multi_line=False
    )
    return root, out


def test_dataset(spark, built):
    root, out = built
    rows = out["flights"].count()
    assert out["modeling"].count() == rows == pipeline.flights(spark, SF).count()
    with_data = {r["station_id"] for r in out["weather"].select("station_id").distinct().collect()}
    mapped = {r["station_id"]: r["mapping_confidence"] for r in out["mapping"].collect()}
    assert with_data and len(mapped) == out["mapping"].count()
    assert all((level == "high") == (station in with_data) for station, level in mapped.items())
    overview = {r["metric"]: r["value"] for r in out["quality_overview"].collect()}
    assert overview["modeling_rows"] == rows and overview["malformed_CRSDepTime"] == 0
    assert 0 < overview["origin_weather_join_rate"] <= 1
    late = out["modeling"].where(F.col("origin_weather_timestamp_utc") > F.col("sched_dep_utc"))
    assert late.count() == 0


def test_final_models(spark, built):
    root, _ = built
    out = runs.final_models(spark, str(root / "out" / "modeling"), str(root / "final"), top_origins=20, settings=LIGHT)
    assert {r["model"] for r in out["model_metrics"].collect()} == {
        "dummy_most_frequent", "logistic_regression_balanced", "random_forest_balanced", "boosted_trees_classifier"
    }
    assert out["imbalance_metrics"].count() == 3 and out["pca_comparison"].count() == 2 and out["regression_metrics"].count() == 3
    best = {(r["task"], r["metric"]): (r["model"], r["value"]) for r in out["best_models"].collect()}
    top = out["model_metrics"].orderBy(F.desc("pr_auc"), F.desc("f1"), F.desc("recall"), "model").first()
    assert len(best) == 6 and best["classification", "pr_auc"] == (top["model"], top["pr_auc"])
    assert best["regression", "mae"][1] == out["regression_metrics"].agg(F.min("mae")).first()[0]
    same = {r["experiment"] if "experiment" in r else r["model"]: r["f1"] for r in out["imbalance_metrics"].collect()}
    plain = {r["model"]: r["f1"] for r in out["model_metrics"].collect()}
    assert same["logistic_class_weight_balanced"] == plain["logistic_regression_balanced"]
    assert out["threshold_metrics"].count() == 20 and out["reduction"].count() == 3
    assert out["feature_ranking"].count() > 20


def test_supplement(spark, built):
    root, _ = built
    names = ["logistic_regression_balanced", "random_forest_balanced"]
    out = runs.supplement(spark, str(root / "out" / "modeling"), str(root / "more"), folds=2, names=names, settings=LIGHT, rounds=19)
    assert out["fold_metrics"].count() == 4 and out["model_summary"].count() == 2 and out["cluster_summary"].count() == 3
    assert out["pairwise_f1"].count() == 1 and out["rate_by_precipitation"].count() == 5


def test_prompts(spark, built):
    root, _ = built
    prompts = runs.row_prompts(spark, str(root / "out" / "modeling"), str(root / "text"), sample=20, few_shot=4)
    rows = prompts.collect()
    assert len(rows) == 20 and all(r["prompt"].count("Example: ") == 4 for r in rows)
    answers = prompts.withColumn("answer", F.when(F.col("dep_delayed_15") == 1, "DELAY").otherwise("hm"))
    scored = runs.score_row_answers(spark, answers, "Some/Model", str(root / "answers"), sample=20, few_shot=4)
    metrics = scored["answer_metrics"].first()
    assert (metrics["evaluation_rows_requested"], metrics["few_shot_examples"], metrics["top_origins"]) == (20, 4, 0)
    assert metrics["accuracy"] == 1.0 and metrics["slug"] == "some_model" and metrics["valid_prediction_rate"] == 0.5
