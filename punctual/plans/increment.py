"""History features month by month: each batch continues from a saved state instead of reading the months before.

The state holds, at an instant, one row for each key: sums and counts of every prior mean, the rows of the last
hour, the last leg.  A batch reads its own rows and the state, and leaves the next state.  Batches must follow each
other in time: every row of a batch is later than the state's instant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.operators.history import hour_totals, last_legs, mean_totals, previous_leg, prior_count_in_hour, prior_means


@dataclass(frozen=True)
class HistoryPlan:
    """What is calculated: columns, and for each prior mean its keys."""

    time: str
    delay: str
    means: dict[str, Sequence[str]]
    entity: str
    count_name: str
    vehicle: str
    leg_value: str
    leg_name: str
    leg_flag: str
    tie_order: Sequence[str]


@dataclass
class HistoryState:
    means: dict[str, DataFrame]
    hours: DataFrame
    legs: DataFrame
    upto: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {**{f"mean_{n}": d for n, d in self.means.items()}, "hours": self.hours, "legs": self.legs, "upto": self.upto}

    def save(self, path: str) -> None:
        """Write the state to a new folder.  The table of the instant comes last: with it the state is whole."""
        for name, df in self.tables().items():
            df.write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, plan: HistoryPlan) -> HistoryState | None:
        """A saved state; None where there is none, or one that was not written to its end."""
        try:
            upto = spark.read.parquet(f"{path}/upto")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return HistoryState({n: read(f"mean_{n}") for n in plan.means}, read("hours"), read("legs"), upto)


def continue_history(
    df: DataFrame, plan: HistoryPlan, state: HistoryState | None = None, buckets: int | None = None
) -> tuple[DataFrame, HistoryState]:
    """(the rows with their history features, the state after them).

    Equal to one calculation over all batches.  A row at or before the state's instant is an error.  Rows without
    a time know the state and the rows of their own batch, and leave nothing to later ones.
    """
    if state is not None:
        upto = state.upto.first()[0]
        early = upto is not None and df.where(F.col(plan.time).cast("timestamp") <= F.lit(upto)).limit(1).count()
        if early:
            raise ValueError(f"rows at or before {upto}, where the saved history ends")
    old = state or HistoryState(None, None, None, None)
    out = prior_means(df, plan.time, plan.delay, plan.means, plan.tie_order, buckets=buckets, source=df, earlier=old.means)
    out = prior_count_in_hour(out, plan.time, plan.entity, plan.count_name, plan.tie_order, buckets, df, old.hours)
    out = previous_leg(
        out, plan.time, plan.vehicle, plan.leg_value, plan.leg_name, plan.leg_flag, plan.tie_order, buckets=buckets, source=df, earlier=old.legs
    )
    moment = df.select(F.col(plan.time).cast("timestamp").alias("upto"))
    if state is not None:
        moment = moment.unionByName(state.upto)
    after = HistoryState(
        mean_totals(df, plan.time, plan.delay, plan.means, earlier=old.means),
        hour_totals(df, plan.time, plan.entity, old.hours),
        last_legs(df, plan.time, plan.vehicle, plan.leg_value, plan.tie_order, old.legs),
        moment.agg(F.max("upto").alias("upto")),
    )
    return out, after
