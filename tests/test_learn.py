from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from punctual import session
from punctual.learn import evaluate, importance, information, models, nearest, prep, smote, stats
from punctual.plans import prompts


# --- metrics -----------------------------------------------------------------------------------
def scores(spark, rows):
    return spark.createDataFrame(rows, "model string, y int, score double")


def test_rank_metrics_golden(spark):
    df = scores(spark, [("m", 0, 0.1), ("m", 0, 0.4), ("m", 1, 0.35), ("m", 1, 0.8)])
    r = evaluate.rank_metrics(df, ["model"]).first()
    assert r["roc_auc"] == 0.75 and r["pr_auc"] == pytest.approx(5 / 6)


def brute_auc_ap(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap, seen, last = 0.0, 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        ap += (recall - last) * precision
        last = recall
    assert seen == 0.0
    return auc, ap


@pytest.mark.parametrize("buckets", [1, 7])
def test_rank_metrics_equal_brute_force(spark, buckets):
    rng = np.random.default_rng(2)
    rows = []
    for m, n in (("big", 400), ("small", 30)):
        y = rng.integers(0, 2, n)
        s = np.round(np.clip(rng.normal(0.4 + 0.1 * y, 0.2), 0, 1), 2)
        rows += [(m, int(a), float(b)) for a, b in zip(y, s)]
    for r in evaluate.rank_metrics(scores(spark, rows), ["model"], buckets).collect():
        y = np.array([a for m, a, _ in rows if m == r["model"]])
        s = np.array([b for m, _, b in rows if m == r["model"]])
        auc, ap = brute_auc_ap(y, s)
        assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)


def test_metrics_at_the_edges(spark):
    df = scores(spark, [("m", 0, 0.2), ("m", 0, 0.3)])
    r = evaluate.class_metrics(df, ["model"]).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    k = evaluate.rank_metrics(df, ["model"]).first()
    assert k["roc_auc"] is None and k["pr_auc"] == 0.0
    assert evaluate.class_metrics(scores(spark, [("m", 1, 0.5)]), ["model"]).first()["recall"] == 1.0
    ties = evaluate.rank_metrics(scores(spark, [("m", 1, 0.5), ("m", 0, 0.5)]), ["model"]).first()
    assert ties["roc_auc"] == 0.5 and ties["pr_auc"] == 0.5


def test_sweep_and_calibration(spark):
    df = scores(spark, [("m", i % 2, i / 100) for i in range(100)])
    sweep = {r["threshold"]: r for r in evaluate.threshold_sweep(df, ["model"]).collect()}
    assert list(sorted(sweep)) == evaluate.THRESHOLDS and sweep[0.5]["recall"] == 0.5
    bins = evaluate.calibration_table(df.drop("model")).collect()
    assert sorted(r["rows"] for r in bins) == [10] * 10 and {r["bin"] for r in bins} == set(range(10))
    constant = evaluate.calibration_table(scores(spark, [("m", 1, 0.5)] * 4), ["model"]).collect()
    assert [(r["bin"], r["rows"]) for r in constant] == [(0, 4)]


def test_confusion_and_valid(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, None)], "y int, pred int")
    assert {r["component"]: r["count"] for r in evaluate.confusion_matrix(df).collect()} == {"TN": 1, "FP": 0, "FN": 1, "TP": 1}
    r = evaluate.valid_prediction_metrics(df).first()
    assert r["evaluation_rows_valid"] == 3 and r["accuracy"] == pytest.approx(2 / 3) and r["valid_prediction_rate"] == 0.75
    none = evaluate.valid_prediction_metrics(df.where("pred IS NULL")).first()
    assert none["accuracy"] is None and none["valid_prediction_rate"] == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "y double, pred double")
    r = evaluate.regression_metrics(df).first()
    assert (r["mae"], r["rmse"], r["r2"]) == pytest.approx((1.0, np.sqrt(5 / 3), 1 - 5 / 8))


# --- group comparison --------------------------------------------------------------------------
# fixed values: published fold means and deviations of four models over four folds
PUBLISHED = {
    "f1": ([0.3469, 0.4921, 0.3743, 0.4754], [0.0868, 0.0482, 0.0995, 0.0474], 3.8037, 0.01),
    "pr_auc": ([0.5087, 0.5026, 0.4896, 0.4814], [0.0613, 0.0611, 0.0779, 0.0572], 0.1447, 0.002),
    "roc_auc": ([0.7360, 0.7327, 0.7255, 0.7202], [0.0119, 0.0120, 0.0198, 0.0096], 1.0554, 0.03),
}


@pytest.mark.parametrize("metric", list(PUBLISHED))
def test_anova_reproduces_published_figures(spark, metric):
    means, deviations, f, tolerance = PUBLISHED[metric]
    rows = [(f"m{i}", 4, m, s * s) for i, (m, s) in enumerate(zip(means, deviations))]
    r = stats.anova_from_stats(spark.createDataFrame(rows, "model string, n bigint, mean double, var double")).first()
    assert (r["df1"], r["df2"]) == (3, 12) and r["f_statistic"] == pytest.approx(f, abs=tolerance)


def test_permutation_p_values(spark):
    rng = np.random.default_rng(0)
    rows = [(m, i, float(rng.normal(c, 0.1))) for m, c in (("a", 0.0), ("b", 0.0), ("c", 1.0)) for i in range(6)]
    df = spark.createDataFrame(rows, "model string, fold int, f1 double")
    test, pairs = stats.significance(df, "model", "f1", ["model", "fold"], rounds=199)
    assert test.first()["p_value"] <= 0.01
    got = {(r["group1"], r["group2"]): r for r in pairs.collect()}
    assert not got["a", "b"]["reject"] and got["a", "c"]["reject"] and got["b", "c"]["reject"]
    assert got["a", "c"]["meandiff"] == pytest.approx(np.mean([v for m, _, v in rows if m == "c"]) - np.mean([v for m, _, v in rows if m == "a"]))


@pytest.mark.parametrize("n", [1, 2, 3, 30, 64, 65, 1000])
def test_places_are_permutations(spark, n):
    """Every round deals each place once; rounds differ; a place is about as likely as any other."""
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("round"))
    rows = rows.withColumn("keys", stats.round_keys(5, 40, F.col("round")))
    places = rows.select("id", "round", stats.permuted_place(F.col("id"), n, F.col("keys")).alias("place")).toPandas()
    for _, part in places.groupby("round"):
        assert sorted(part["place"]) == list(range(n))
    if n >= 30:
        assert places.groupby("id")["place"].nunique().min() > 10
        assert abs(places["place"].corr(places["id"])) < 0.1


def test_a_round_is_no_window(spark):
    rows = [(f"m{i % 3}", i, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "model string, fold int, f1 double")
    dealt = stats.permuted(df, "model", "f1", ["fold"], 20)
    assert "Window" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    got = dealt.toPandas()
    for _, part in got.groupby("round"):
        assert sorted(part["f1"]) == sorted(r[2] for r in rows) and part["model"].value_counts().to_dict() == {"m0": 17, "m1": 17, "m2": 16}


# --- preparation -------------------------------------------------------------------------------
def training(spark, n=600):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        x, z = rng.normal(), rng.normal()
        c = "abc"[i % 3] if i % 11 else None
        y = int(x + (0.8 if c == "a" else 0) + rng.normal(0, 0.4) > 0.7)
        rows.append((i, x if i % 7 else None, z, 5.0, c, y, 10 * x + z + 3))
    return spark.createDataFrame(rows, "id int, x double, z double, flat double, c string, y int, t double")


def test_prep_kinds(spark):
    df = training(spark)
    fresh = spark.createDataFrame([(1, None, 0.0, 5.0, "new", 0, 0.0), (2, 1.0, 0.0, 5.0, None, 0, 0.0)], df.schema)
    hot = prep.fit_prep(df, ["c"], ["x", "z", "flat"], "onehot")
    assert hot.names == ["c_a", "c_b", "c_c", "x", "z", "flat"]
    got = {r["id"]: r["f"] for r in hot.transform(fresh).select("id", vector_to_array("features").alias("f")).collect()}
    assert got[1][:3] == [0.0, 0.0, 0.0] and sum(got[2][:3]) == 1.0 and got[1][5] == 0.0
    train_x = np.array([r["f"] for r in hot.transform(df).select(vector_to_array("features").alias("f")).collect()])
    assert train_x[:, 3:5].mean(axis=0) == pytest.approx([0, 0], abs=1e-9) and train_x[:, 3:5].std(axis=0) == pytest.approx([1, 1])
    ordinal = prep.fit_prep(df, ["c"], ["x", "z"], "ordinal")
    codes = {r["id"]: r["f"][0] for r in ordinal.transform(fresh).select("id", vector_to_array("features").alias("f")).collect()}
    assert codes[1] == -1.0 and codes[2] in (0.0, 1.0, 2.0)
    known = np.sort([r["x"] for r in df.select("x").dropna().collect()])
    assert ordinal.book.medians["x"] == pytest.approx(np.median(known))
    projected = prep.fit_prep(df, ["c"], ["x", "z", "t"], "pca")
    assert projected.components == 2 and projected.names[-2:] == ["pc1", "pc2"]


def test_prep_drops_empty_columns(spark):
    df = training(spark).withColumns({"void": F.lit(None).cast("double"), "blank": F.lit(None).cast("string"), "quote": F.lit("it's a \\ b")})
    fitted = prep.fit_prep(df, ["c", "blank", "quote"], ["x", "void"], "onehot")
    assert fitted.names == ["c_a", "c_b", "c_c", "quote_it's a \\ b", "x"]
    first = fitted.transform(df.withColumn("quote", F.lit(None).cast("string"))).select(vector_to_array("features")[3]).first()
    assert first[0] == 1.0


def test_prep_learns_from_train_only(spark):
    df = training(spark)
    fitted = prep.fit_prep(df, ["c"], ["x"], "onehot")
    far = df.withColumn("x", F.col("x") + 1000)
    moved = fitted.transform(far).select(vector_to_array("features").alias("f")).agg(F.avg(F.col("f")[3])).first()[0]
    assert moved > 100


def test_scores_of_features(spark):
    df = training(spark)
    f = {r["feature"]: r["f_score"] for r in prep.f_scores(df, ["x", "z", "flat"], "y").collect()}
    mi = {r["feature"]: r["mutual_information"] for r in prep.binned_mutual_information(df, ["x", "z"], ["c"], "y").collect()}
    assert f["x"] > 50 > f["z"] and f["flat"] is None
    assert mi["x"] > mi["z"] >= 0
    ranking = prep.feature_ranking(df, ["c"], ["x", "z", "flat"], "y", "t").collect()
    assert ranking[0]["feature"] == "x" and ranking[0]["abs_numeric_correlation_rank"] == 1


def plain_information(rows, k):
    """The estimate by looking at every pair; digamma of whole numbers from harmonic sums."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    classes = {}
    for y, v in rows:
        classes.setdefault(y, []).append(v)
    use = [(y, v) for y, v in rows if len(classes[y]) > 1]
    total = 0.0
    for i, (y, v) in enumerate(use):
        size = len(classes[y])
        near = sorted(abs(v - w) for j, (z, w) in enumerate(use) if z == y and j != i)
        r = near[min(k, size - 1) - 1]
        m = sum(v - r < w < v + r if r > 0 else w == v for _, w in use)
        total += psi(min(k, size - 1) if r > 0 else near.count(0.0)) - psi(size) - psi(m)
    return max(psi(len(use)) + total / len(use), 0.0)


@pytest.mark.parametrize(("buckets", "positions"), [(1, 200_000), (7, 20)])
def test_information_by_neighbours(spark, monkeypatch, buckets, positions):
    """Few values and many, classes of one, two and three rows, one class with most rows; nulls left out."""
    monkeypatch.setattr(information, "POSITIONS", positions)
    rng = np.random.default_rng(4)
    rows = [("big" if rng.random() < 0.5 else f"c{rng.integers(0, 4)}", float(rng.normal()), float(rng.integers(0, 6))) for _ in range(260)]
    rows = [(y, u + (y == "big"), v) for y, u, v in rows] + [("one", 0.0, 1.0), ("two", 3.0, 1.0), ("two", 3.5, 1.0), ("three", 1.0, 2.0), ("three", 1.0, 2.0), ("three", 9.0, 2.0)]
    odd = [("big", None, float("nan")), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "y string, u double, v double").withColumn("void", F.lit(None).cast("double"))
    got = {r["feature"]: r["mutual_information"] for r in information.neighbour_mutual_information(df, ["u", "v", "void"], "y", 3, buckets).collect()}
    want = {"u": plain_information([(y, u) for y, u, _ in rows], 3), "v": plain_information([(y, v) for y, _, v in rows], 3)}
    assert got == pytest.approx(want, abs=1e-9) and want["u"] > 0.05


def test_digamma(spark):
    n = F.col("id").cast("double")
    got = [r["d"] for r in spark.range(1, 200).select(information.digamma(n).alias("d")).collect()]
    assert got == pytest.approx([-0.5772156649015329 + sum(1 / i for i in range(1, n)) for n in range(1, 200)], abs=1e-11)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r["y"]: r["weight"] for r in prep.class_weights(df, "y").collect()} == pytest.approx({0: 8 / 12, 1: 2.0})


# --- models ------------------------------------------------------------------------------------
LIGHT = models.Settings(trees=10, tree_depth=5, leaf_rows=2, rounds=8, boost_depth=3, net_iterations=40)


def test_classifiers_learn(spark):
    df = training(spark).cache()
    train, test = df.where("id < 450"), df.where("id >= 450")
    run = models.run_classification(train, test, ["c"], ["x", "z"], "y", ["id"], [*models.CLASSIFIERS, "mlp_classifier"], LIGHT)
    rows = {r["model"]: r for r in run.metrics.collect()}
    assert set(rows) == {*models.CLASSIFIERS, "mlp_classifier"} and run.best != "dummy_most_frequent"
    assert rows["dummy_most_frequent"]["roc_auc"] == 0.5 and rows["dummy_most_frequent"]["f1"] == 0.0
    assert all(rows[m]["roc_auc"] > 0.75 for m in rows if m != "dummy_most_frequent")
    assert run.thresholds.count() == 5 * 5 and run.predictions.count() == 5 * 150
    weights = importance.model_importance(spark, run.fitted["random_forest_balanced"]).collect()
    assert weights[0]["feature"] == "x"
    moved = importance.permutation_importance(run.fitted["logistic_regression_balanced"], test, ["id"]).collect()
    assert moved[0]["feature"] == "x" and {r["feature"] for r in moved} == {"c", "x", "z"}


def test_net_stops_early_and_takes_its_best_round(spark):
    from pyspark.ml.feature import VectorAssembler

    from punctual.learn import net

    # separable by a wide margin: all rows kept aside are right after the first rounds
    rows = spark.range(400).selectExpr("cast(id % 2 as double) y", "(id % 2) * 8 - 4 + (id % 37) / 37.0 a", "(id % 11) / 11.0 b")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("y", "features").persist()
    model, rounds = net.fit_net(rows, "y", [2, 4, 2], 200, 3)
    taken = [r for r in rounds if r[4]]
    assert len(taken) == 1 and taken[0][3] == max(r[3] for r in rounds) == 1.0
    assert rounds[-1][1] < 200 and rounds[-1][1] - taken[0][1] >= net.PATIENCE
    assert [r[1] for r in rounds] == [net.ROUND * (i + 1) for i in range(len(rounds))]
    aside = rows.where(net.kept_aside(3))
    assert 0 < aside.count() < 200 and aside.count() == model.transform(aside).where("prediction = y").count()
    assert net.round_table(spark, rounds).where("best").count() == 1
    # no more iterations than asked for, and all rows at once if none can be kept aside
    assert [r[1] for r in net.fit_net(rows, "y", [2, 4, 2], 7, 3)[1]] in ([5, 7], [5])
    assert net.fit_net(rows, "y", [2, 4, 2], 7, 3, early_stop=False)[1] == []
    assert net.fit_net(rows.limit(1), "y", [2, 4, 2], 2, 3)[1] == []
    rows.unpersist()


def test_regressors_learn(spark):
    df = training(spark)
    metrics, _ = models.run_regression(df.where("id < 450"), df.where("id >= 450"), [], ["x", "z"], "t", ["id"], settings=LIGHT)
    rows = metrics.collect()
    assert [r["model"] for r in rows][0] == "linear_regression" and all(r["r2"] > 0.4 for r in rows)


def test_fold_grid(spark):
    df = training(spark).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 20).cast("int")))
    grid = models.run_fold_grid(df, "d", 2, ["c"], ["x"], "y", ["id"], ["logistic_regression_balanced"], LIGHT).collect()
    assert [(r["fold"], r["train_rows"], r["test_rows"], r["dataset_rows"]) for r in sorted(grid, key=lambda r: r["fold"])] == [
        (1, 200, 200, 600), (2, 400, 200, 600)
    ]


def test_clusters(spark):
    rows = [(f"a{i}", c + i * 0.01, -c) for c in (0.0, 10.0, 20.0) for i in range(4)]
    df = spark.createDataFrame([(f"{n}{c}", x, c) for n, x, c in rows], "k string, u double, v double")
    out = models.project_2d(models.cluster_profiles(df, ["u", "v"], starts=5), ["u", "v"]).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["v"], set()).add(r["cluster"])
    assert len({frozenset(g) for g in groups.values()}) == 3 and all(len(g) == 1 for g in groups.values())
    assert np.corrcoef([r["pc1"] for r in out], [r["u"] for r in out])[0, 1] ** 2 > 0.99


# --- oversampling ------------------------------------------------------------------------------
def brute_neighbours(rows, penalty, k):
    """Of each row (key, numbers, categories) the k nearest others, from all pairs."""
    def square(a, b):
        total = 0.0
        for x, y in zip(a[1], b[1], strict=True):
            total += (x - y) * (x - y)
        for x, y in zip(a[2], b[2], strict=True):
            total += penalty * penalty if x != y else 0.0
        return total

    return {a[0]: [key for _, key in sorted((square(a, b), b[0]) for b in rows if b[0] != a[0])[:k]] for a in rows}


@pytest.mark.parametrize(("cell", "block"), [(None, None), (40, 25), (9, 4), (1000, 7)])
def test_neighbours_equal_brute_force(spark, cell, block):
    """One block, many cells, crowded cells; a third of the rows are one point, others repeat."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).round(1).tolist(), [str(rng.integers(0, 3)), "u"]) for i in range(160)]
    rows += [(500 + i, [0.5, 0.5, 0.5], ["1", "u"]) for i in range(80)]
    df = spark.createDataFrame([(k, *v, *c) for k, v, c in rows], "id long, x double, y double, z double, c string, d string").repartition(5)
    got = {}
    for r in nearest.nearest_rows(df, "id", ["x", "y", "z"], ["c", "d"], 0.7, 5, cell, block).orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute_neighbours(rows, 0.7, 5)


def test_neighbours_of_few_rows_and_text_keys(spark):
    df = spark.createDataFrame([("b", 0.0), ("é", 2.0), ("a", 1.0)], "k string, x double")
    got = {(r["k"], r["rank"]): (r["neighbour"], r["distance"]) for r in nearest.nearest_rows(df, "k", ["x"]).collect()}
    assert got == {("b", 1): ("a", 1.0), ("b", 2): ("é", 2.0), ("a", 1): ("b", 1.0), ("a", 2): ("é", 1.0), ("é", 1): ("a", 1.0), ("é", 2): ("b", 2.0)}
    assert nearest.nearest_rows(df.limit(1), "k", ["x"]).count() == nearest.nearest_rows(df.limit(0), "k", ["x"]).count() == 0


def test_cells_prune(spark):
    """Points in far clusters meet only their own cells."""
    rng = np.random.default_rng(5)
    rows = [(i, float(1000 * (i % 20) + rng.normal()), float(rng.normal())) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(4)
    asked = []
    keep = nearest.staged
    nearest.staged = lambda d: asked.append(d) or keep(d)
    try:
        nearest.nearest_rows(df, "id", ["x", "y"], cell=25, block=50).count()
    finally:
        nearest.staged = keep
    sent = [d for d in asked if d.columns == ["key", "numbers", "codes", "radius", "cell", "block"]][0].count()
    assert sent < 2000 * 12


def test_smote(spark):
    df = training(spark).withColumns({"x": F.coalesce("x", F.lit(0.0)), "c": F.coalesce("c", F.lit("a"))})
    counts = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    small = min(counts, key=counts.get)
    grown = smote.smote_nc(df, ["x", "z"], ["c"], "y", ["id"])
    after = {r["y"]: r["count"] for r in grown.groupBy("y").count().collect()}
    assert after[0] == after[1] == max(counts.values())
    low, high = df.where(F.col("y") == small).agg(F.min("x"), F.max("x")).first()
    synthetic = grown.where(F.col("y") == small)
    assert synthetic.where(~F.col("x").between(low - 1e-9, high + 1e-9)).count() == 0
    assert {r["c"] for r in synthetic.select("c").distinct().collect()} <= {"a", "b", "c"}
    again = smote.smote_nc(df.repartition(7), ["x", "z"], ["c"], "y", ["id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, grown.collect()))


# --- prompts -----------------------------------------------------------------------------------
def test_score_answers(spark):
    df = spark.createDataFrame([("DELAY", 1), ("on_time", 1), ("?", 0), ("no", 0)], "text string, label int")
    parsed, metrics, confusion = prompts.score_answers(df, "text", "label")
    assert [r["pred"] for r in parsed.collect()] == [1, 0, None, 0]
    assert metrics.first()["evaluation_rows_valid"] == 3
    assert {r["component"]: r["count"] for r in confusion.collect()}["TP"] == 1


def test_training_rows_are_spread_over_the_cores(spark, monkeypatch):
    """One file makes one partition; training must not run in one task for that."""
    rows = spark.range(400).selectExpr("id", "concat('c', id % 3) AS c", "double(id % 17) AS x", "int(id % 5 = 0) AS y", "double(id % 7) AS z").coalesce(1)
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    wanted, seen = min(4, spark.sparkContext.defaultParallelism), []
    kept = lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count()))
    for kind in (models.RandomForestClassifier, models.GBTClassifier, models.RandomForestRegressor, models.GBTRegressor, models.LogisticRegression):
        monkeypatch.setattr(kind, "fit", kept)
    for name in ("random_forest_balanced", "boosted_trees_classifier", "logistic_regression_balanced"):
        models.fit_classifier(name, rows, ["c"], ["x"], "y")
    for name in ("random_forest_regressor", "boosted_trees_regressor"):
        models.fit_regressor(name, rows, ["c"], ["x"], "z")
    assert seen == [(wanted, 400)] * 5


def test_oversampled_rows_are_spread(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id", "concat('c', id % 3) AS c", "double(id % 17) AS x", "int(id % 5 = 0) AS y").coalesce(1)
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    seen = []
    monkeypatch.setattr(smote.LogisticRegression, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())))
    smote.fit_oversampled_logistic(rows, "y", lambda df: df.unionByName(df).coalesce(1), prep.PrepBook(rows, ["c"], ["x"]))
    assert seen == [(min(8, spark.sparkContext.defaultParallelism), 800)]


def test_forest_keeps_nodes_between_passes(spark):
    rows = spark.range(300).selectExpr("concat('c', id % 3) AS c", "double(id % 17) AS x", "int(id % 5 = 0) AS y")
    fitted = models.fit_classifier("random_forest_balanced", rows, ["c"], ["x"], "y", models.Settings(trees=3, tree_depth=4))
    assert fitted.model.getCacheNodeIds()
