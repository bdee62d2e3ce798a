"""Row prompts with labelled examples, and the scoring of the answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.values import PROMPT_HEAD, label_name, parse_label, row_text
from punctual.learn.evaluate import confusion_matrix, valid_prediction_metrics
from punctual.operators.split import balanced_sample, temporal_split


def build_prompts(rows: DataFrame, examples: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Rows with a ``prompt``: instructions, the examples in order, the row itself.

    The examples are the caller's few shots; they reach the rows as one scalar text.
    """
    line = F.concat(F.lit("Example: "), row_text({}), F.lit(" -> "), label_name(F.col(label)))
    listed = F.sort_array(F.collect_list(F.struct(*order, line.alias("__line"))))
    shots = examples.agg(F.array_join(F.transform(listed, lambda s: s["__line"]), "\n").alias("shots"))
    target = F.concat(F.lit("Target row: "), row_text({}))
    return rows.withColumn(
        "prompt", F.concat_ws("\n", *[F.lit(t) for t in PROMPT_HEAD], shots.scalar(), target, F.lit("Prediction:"))
    )


def sampled_prompts(
    frame: DataFrame, label: str, identity: Sequence[str], day: str = "FlightDate", evaluate: int = 80, few_shot: int = 8
) -> DataFrame:
    """Prompts for a balanced sample of the test dates, with examples from the train dates."""
    train, test, _ = temporal_split(frame, day)
    rows = balanced_sample(test, label, evaluate, identity)
    return build_prompts(rows, balanced_sample(train, label, few_shot, identity), label, identity)


def score_answers(answers: DataFrame, text: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers with the parsed label, metrics over valid answers, confusion table)."""
    parsed = answers.withColumns({"pred": parse_label(F.col(text)), "y": F.col(label)})
    return parsed, valid_prediction_metrics(parsed), confusion_matrix(parsed)
