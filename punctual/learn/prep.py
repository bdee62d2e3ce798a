"""Imputation, encoding, scaling, projection; fitted on the training rows only.

What is learnt about a column (mode, median, mean, deviation, bin edges) is one row per
feature, so it comes to the driver and goes into the plan as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    PCA, OneHotEncoder, PCAModel, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.learn.information import neighbour_mutual_information
from punctual.operators.aggregate import dense_rank_abs, missing_rates, pearson_with
from punctual.operators.quantile import exact_quantiles
from punctual.operators.scan import OrderedScan

VARIANCE_KEPT = 0.95


# --- single steps ------------------------------------------------------------------------
def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mode): the most frequent value, ties to the smallest."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median): exact and interpolated."""
    return exact_quantiles(df, columns, [0.5]).select("feature", F.col("quantile").alias("median"))


def ordinal_dictionary(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """(value, code): the distinct values numbered from 0 in order."""
    values = df.select(F.col(column).alias("value")).dropna().distinct()
    return OrderedScan(values, [], ["value"], buckets).prior_count("code").result()


def ordinal_encode(df: DataFrame, dictionary: DataFrame, column: str, name: str) -> DataFrame:
    """Codes from a dictionary; values it lacks get -1."""
    coded = df.join(dictionary.select(F.col("value").alias(column), F.col("code").alias("__code")), column, "left")
    return coded.withColumn(name, F.coalesce("__code", F.lit(-1).cast("bigint"))).drop("__code")


def mean_and_deviation(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def scaled(c: Column, mean: float, deviation: float) -> Column:
    """Population z-score; a constant column gives 0."""
    return (c - F.lit(mean)) / F.lit(deviation) if deviation else c * 0.0


def standardize(df: DataFrame, columns: Sequence[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    fitted = fitted or mean_and_deviation(df, columns)
    return df.withColumns({c: scaled(F.col(c), *fitted[c]) for c in columns})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    return counts.select(
        label, (totals.select("rows").scalar() / (totals.select("classes").scalar() * F.col("n"))).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights as literals: one number per class."""
    weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    out = F.lit(None).cast("double")
    for value, weight in weights.items():
        out = F.when(F.col(label) == value, F.lit(weight)).otherwise(out)
    return df.withColumn(name, out)


# --- the fitted preparation ---------------------------------------------------------------
def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass
class Prep:
    """Fitted preparation.  ``kind`` is ``onehot`` (scaled numbers, one-hot codes), ``ordinal``
    (raw numbers, ordinal codes) or ``pca`` (projected numbers, one-hot codes)."""

    kind: str
    book: PrepBook
    stages: list[Transformer] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    components: int | None = None
    variance: float | None = None  # share of the numbers' variance that the components keep

    @property
    def most_categories(self) -> int:
        return max([0, *map(len, self.book.indexer.labelsArray)]) if self.categorical else 0

    @property
    def categorical(self) -> list[str]:
        return self.book.categorical

    @property
    def numeric(self) -> list[str]:
        return self.book.numeric

    def numbers(self, df: DataFrame) -> DataFrame:
        """Filled frame with the number columns as the model sees them, prefixed ``__n_``."""
        df = self.book.impute(df)
        shown = {}
        for c in self.numeric:
            if self.kind == "ordinal":
                shown[f"__n_{c}"] = F.col(c)
            else:
                mean, deviation = self.book.moments[c]
                divisor = f"/ {_number(deviation)}" if deviation else "* 0.0D"
                shown[f"__n_{c}"] = F.expr(f"(`{c}` - {_number(mean)}) {divisor}")
        return df.withColumns(shown) if shown else df

    def codes(self, df: DataFrame) -> DataFrame:
        """Code columns ``__c_x``; with ``ordinal`` also ``__o_x``, where unknown values are -1."""
        if not self.categorical:
            return df
        df = self.book.indexer.transform(df)
        if self.kind == "ordinal":
            known = {c: len(labels) for c, labels in zip(self.categorical, self.book.indexer.labelsArray)}
            df = df.withColumns({
                f"__o_{c}": F.expr(f"CASE WHEN `__c_{c}` >= {known[c]} THEN -1.0D ELSE `__c_{c}` END") for c in self.categorical
            })
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame with a ``features`` vector."""
        out = PipelineModel(self.stages).transform(self.codes(self.numbers(df)))
        return out.drop(*[c for c in out.columns if c.startswith("__")])


class PrepBook:
    """What one training frame teaches, shared by all model families trained on it.

    Modes, medians, moments and category lists are found once, however many models follow.
    """

    def __init__(self, train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]):
        self.train = train
        self.categorical, self.numeric = list(categorical), list(numeric)
        self.modes = {r["feature"]: r["mode"] for r in column_modes(train, self.categorical).collect()} if categorical else {}
        self.medians = {r["feature"]: r["median"] for r in column_medians(train, self.numeric).collect()} if numeric else {}
        # a column without any training value teaches nothing
        self.categorical = [c for c in self.categorical if c in self.modes]
        self.numeric = [c for c in self.numeric if c in self.medians]
        self._kinds: dict[str, Prep] = {}

    def impute(self, df: DataFrame) -> DataFrame:
        filled = {c: F.expr(f"coalesce(cast(`{c}` as string), {_text(self.modes[c])})") for c in self.categorical}
        for c in self.numeric:
            value = f"cast(`{c}` as double)"
            filled[c] = F.expr(f"coalesce(CASE WHEN NOT isnan({value}) THEN {value} END, {_number(self.medians[c])})")
        return df.withColumns(filled) if filled else df

    @cached_property
    def moments(self) -> dict[str, tuple[float, float]]:
        return mean_and_deviation(self.impute(self.train), self.numeric) if self.numeric else {}

    @cached_property
    def indexer(self) -> StringIndexerModel:
        return StringIndexer(
            inputCols=self.categorical, outputCols=[f"__c_{c}" for c in self.categorical],
            handleInvalid="keep", stringOrderType="alphabetAsc",
        ).fit(self.impute(self.train).select(*self.categorical))

    def prep(self, kind: str) -> Prep:
        if kind not in self._kinds:
            self._kinds[kind] = self._fit(kind)
        return self._kinds[kind]

    def _fit(self, kind: str) -> Prep:
        prep = Prep(kind, self)
        number_columns = [f"__n_{c}" for c in self.numeric]
        if kind == "ordinal":
            inputs = [f"__o_{c}" for c in self.categorical] + number_columns
            prep.names = [*self.categorical, *self.numeric]
        else:
            inputs = []
            if self.categorical:
                # the encoder learns only the number of categories, from the column's metadata
                some = prep.codes(self.impute(self.train))
                hot = [f"__h_{c}" for c in self.categorical]
                prep.stages.append(OneHotEncoder(inputCols=[f"__c_{c}" for c in self.categorical], outputCols=hot).fit(some))
                inputs += hot
                for c, labels in zip(self.categorical, self.indexer.labelsArray):
                    prep.names += [f"{c}_{label}" for label in labels]
            if kind == "pca":
                packed = VectorAssembler(inputCols=number_columns, outputCol="__numbers")
                ready = packed.transform(prep.numbers(self.train).select(*number_columns))
                model, keep, kept = fit_pca(ready, "__numbers", "__all_components", len(self.numeric))
                cut = VectorSlicer(inputCol="__all_components", outputCol="__components", indices=list(range(keep)))
                prep.stages += [packed, model, cut]
                prep.components, prep.variance = keep, kept[keep - 1]
                inputs.append("__components")
                prep.names += [f"pc{i + 1}" for i in range(keep)]
            else:
                inputs += number_columns
                prep.names += self.numeric
        prep.stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
        return prep


def fit_prep(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], kind: str) -> Prep:
    """Learn the preparation of one model family."""
    return PrepBook(train, categorical, numeric).prep(kind)


# --- projection -----------------------------------------------------------------------------
def fit_pca(df: DataFrame, column: str, output: str, size: int, kept: float = VARIANCE_KEPT) -> tuple[PCAModel, int, list[float]]:
    """(model with all components, how many reach the kept share, cumulative shares).

    The input must be centred.  The covariance matrix has one row per feature.
    """
    model = PCA(k=size, inputCol=column, outputCol=output).fit(df)
    cumulative, total = [], 0.0
    for share in model.explainedVariance.toArray():
        total += float(share)
        cumulative.append(total)
    selected = next((i + 1 for i, v in enumerate(cumulative) if v >= kept), size)
    return model, selected, cumulative


def pca_report(
    train: DataFrame, numeric: Sequence[str], book: PrepBook | None = None
) -> tuple[DataFrame, DataFrame]:
    """(variance curve, top loadings): shares per component, and for the first five at most the
    ten features with the largest loadings."""
    prep = (book or PrepBook(train, [], numeric)).prep("onehot")
    columns = [f"__n_{c}" for c in numeric]
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(prep.numbers(train).select(*columns))
    model, selected, cumulative = fit_pca(ready, "features", "components", len(numeric))
    shares = model.explainedVariance.toArray()
    spark = train.sparkSession
    curve = spark.createDataFrame(
        [(i + 1, float(shares[i]), cumulative[i], int(i + 1 == selected)) for i in range(len(numeric))],
        "component int, variance_ratio double, cumulative double, selected int",
    )
    matrix = model.pc.toArray()
    rows = []
    for k in range(min(selected, 5)):
        ordered = sorted(((abs(float(matrix[j][k])), n, float(matrix[j][k])) for j, n in enumerate(numeric)), reverse=True)
        rows += [(f"PC{k + 1}", float(shares[k]), n, v, a) for a, n, v in ordered[:10]]
    loadings = spark.createDataFrame(
        rows, "component string, explained_variance_ratio double, feature string, loading double, abs_loading double"
    )
    return curve, loadings


# --- feature ranking --------------------------------------------------------------------------
def f_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, f_score): one-way F of each feature by class, one pass."""
    x = lambda c: F.col(c).cast("double")
    by_class = df.groupBy(label).agg(*[
        F.struct(F.count(x(c)).alias("n"), F.avg(x(c)).alias("mean"), F.var_pop(x(c)).alias("var")).alias(c) for c in columns
    ])
    long = by_class.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("s")) for c in columns])))
    n, mean = F.col("s.n"), F.col("s.mean")
    sums = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * mean).alias("s1"),
        F.sum(n * mean * mean).alias("s2"), F.sum(n * F.col("s.var")).alias("within"),
    )
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    return sums.select(
        "feature",
        F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f_score"),
    )


def binned_mutual_information(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, bins: int = 10
) -> DataFrame:
    """(feature, mutual_information) in nats, over quantile bins of numbers and values of
    categories.  Nulls form a bin of their own."""
    edges: dict[str, list[float]] = {c: [] for c in numeric}
    if numeric:
        inner = [i / bins for i in range(1, bins)]
        for r in exact_quantiles(df, numeric, inner).orderBy("feature", "probability").collect():
            edges[r["feature"]].append(r["quantile"])

    def placed(c: str) -> Column:
        value = F.col(c).cast("double")
        bin_number = sum((F.when(value > F.lit(e), 1).otherwise(0) for e in sorted(set(edges[c]))), F.lit(0))
        return F.when(value.isNotNull(), bin_number).cast("string").alias(c)

    names = [*numeric, *categorical]
    binned = df.select(F.col(label).alias("__y"), *[placed(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    cells = binned.unpivot(["__y"], names, "feature", "bin").groupBy("feature", "bin", "__y").agg(F.count(F.lit(1)).alias("n"))
    # H(bin) + H(y) - H(bin, y) from counts alone
    entropy_part = lambda n: F.sum(n * F.log(n))
    joint = cells.groupBy("feature").agg(entropy_part(F.col("n")).alias("joint"), F.sum("n").alias("total"))
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n")).groupBy("feature").agg(entropy_part(F.col("n")).alias("bins"))
    by_y = cells.groupBy("feature", "__y").agg(F.sum("n").alias("n")).groupBy("feature").agg(entropy_part(F.col("n")).alias("ys"))
    total = F.col("total")
    mi = (F.col("joint") - F.col("bins") - F.col("ys") + total * F.log(total)) / total
    return joint.join(by_bin, "feature").join(by_y, "feature").select("feature", F.greatest(mi, F.lit(0.0)).alias("mutual_information"))


def feature_ranking(
    train: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
    label: str = "dep_delayed_15", minutes: str = "dep_delay_minutes", book: PrepBook | None = None,
) -> DataFrame:
    """Per feature: correlation with both targets, mutual information (by neighbours for numbers, from
    counts for categories), F, missing share, rank."""
    names = [*categorical, *numeric]
    prep = (book or PrepBook(train, categorical, numeric)).prep("ordinal")
    encoded = prep.codes(prep.numbers(train)).select(
        label, *[F.col(f"__o_{c}").alias(c) for c in categorical], *[F.col(f"__n_{c}").alias(c) for c in numeric]
    )
    corr = pearson_with(train, numeric, [minutes, label]).withColumnsRenamed(
        {minutes: "pearson_with_delay_minutes", label: "pearson_with_delay_flag"}
    )
    ranked = dense_rank_abs(corr, "pearson_with_delay_minutes", "abs_numeric_correlation_rank")
    mi = binned_mutual_information(encoded, [], categorical, label)
    if numeric:
        mi = mi.unionByName(neighbour_mutual_information(encoded, numeric, label))
    scores = f_scores(encoded, names, label)
    missing = missing_rates(train, names).withColumnRenamed("missing_rate", "missing_rate_train")
    return (
        mi.withColumnRenamed("mutual_information", "mutual_information_class")
        .join(scores.withColumnRenamed("f_score", "f_score_class"), "feature", "left")
        .join(missing, "feature", "left")
        .join(ranked, "feature", "left")
        .orderBy(F.desc("mutual_information_class"), F.desc("f_score_class"), "feature")
    )

