"""Scoring of predictions by category, and the release gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.text import parse_finding
from reviewloom.operators.numbering import numbered


def confusion_counts(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(category, tp, fp, fn). A null prediction misses the expected category; an empty one is a false category too."""
    e, p = F.col(expected), F.col(predicted)
    vote = lambda c, tp, fp, fn: F.struct(c.alias("category"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    votes = F.when(e.eqNullSafe(p), F.array(vote(e, 1, 0, 0))).when(p.isNull(), F.array(vote(e, 0, 0, 1))).otherwise(F.array(vote(e, 0, 0, 1), vote(p, 0, 1, 0)))
    cells = df.select(F.inline(votes))
    return cells.groupBy("category").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def safe_ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def category_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; each 0 where its denominator is."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    scored = counts.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", safe_ratio(2 * p * r, p + r))


def macro_f1(scores: DataFrame) -> DataFrame:
    """One row: the unweighted mean of f1, 0 without categories."""
    return scores.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def regression_gate(current: Column, previous: Column, floor: float) -> Column:
    """At least the floor, and not below the previous release if there is one."""
    return (current >= floor) & (previous.isNull() | (current >= previous))


def paired(predicted: DataFrame, expected: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions beside expectations by row id; raises if a row has no partner."""
    both = predicted.withColumn("_p", F.lit(True)).join(expected.withColumn("_e", F.lit(True)), row_id, "full")
    checked = F.when(F.col("_p") & F.col("_e"), True).otherwise(F.raise_error(F.lit("predictions and expectations differ in length")))
    return both.where(checked).drop("_p", "_e")


def paired_in_order(predicted: DataFrame, expected: DataFrame, predicted_order: Sequence[Column], expected_order: Sequence[Column]) -> DataFrame:
    """(position, predicted, expected): the rows of two tables, as structs, paired by their places in order.

    Raises if one of them has more rows. Both are numbered by a distributed sort and joined
    by number, so neither passes one task; rows that an order leaves tied keep the order
    in which they were read. Two empty tables give an empty one.
    """
    left = numbered(predicted, predicted_order).select("position", F.col("row").alias("predicted"))
    right = numbered(expected, expected_order).select("position", F.col("row").alias("expected"))
    both = left.join(right, "position", "full")
    partners = F.col("predicted").isNotNull() & F.col("expected").isNotNull()
    return both.where(F.when(partners, True).otherwise(F.raise_error(F.lit("predictions and expectations differ in length"))))


#: A predictor maps prompts to generated texts, a batch at a time; made once in each task.
Predictor = Callable[[Sequence[str]], Sequence[str]]
_PREDICTORS: dict[str, Callable[[], Predictor]] = {}


def register_predictor(name: str, make: Callable[[], Predictor]) -> None:
    """``make`` is called in each task, so that a model is loaded where it runs."""
    _PREDICTORS[name] = make


def generated(df: DataFrame, predictor: str | Callable[[], Predictor], prompt: str = "prompt", out: str = "generated", batch: int = 64) -> DataFrame:
    """Adds the texts that a predictor, or one registered by name, generates for a column of prompts."""
    make = _PREDICTORS[predictor] if isinstance(predictor, str) else predictor

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make()
        for p in prompts:
            texts = [t for i in range(0, len(p), batch) for t in predict(p.iloc[i : i + batch].tolist())]
            if len(texts) != len(p):
                raise ValueError("a predictor has to give a text for each prompt")
            yield pd.Series(texts, dtype="object")

    return df.withColumn(out, run(F.col(prompt)))


def evaluation(examples: DataFrame, predictor: str | Callable[[], Predictor], expected: str = "category") -> dict:
    """The report of a predictor over examples (prompt, expected category): examples, macro F1, and the scores of each category.

    What reaches the driver is a row for each category.
    """
    got = generated(examples, predictor).select(F.col(expected).alias("expected"), parse_finding(F.col("generated"))["category"].alias("predicted"))
    counts = confusion_counts(got)
    rows = category_scores(counts).orderBy("category").collect()
    categories = {
        r.category: {"precision": r.precision, "recall": r.recall, "f1": r.f1, "truePositives": r.tp, "falsePositives": r.fp, "falseNegatives": r.fn} for r in rows
    }
    # Each example is a hit or a miss of its expected category.
    return {"exampleCount": sum(r.tp + r.fn for r in rows), "macroF1": sum(r.f1 for r in rows) / len(rows) if rows else 0.0, "categories": categories}


def answered(df: DataFrame, make_client: Callable[[], Callable[[Sequence[str]], Sequence[str]]], prompt: str = "prompt", batch: int = 16) -> DataFrame:
    """Adds ``answer`` and ``warning``: what a chat client says to each prompt, or why it said nothing.

    ``make_client`` is called once in each task and gives a function from a list of prompts to as many
    answers. If a batch fails its prompts are asked one by one, so only those that fail
    themselves have a warning, the error's text; an empty answer has one too. No row is lost and no task
    fails for what a client does; if it can't even be made, every row says so. A null prompt isn't asked.
    """
    kind = T.StructType().add("answer", "string").add("warning", "string")

    def make_predict():
        try:
            client, broken = make_client(), None
        except Exception as e:  # noqa: BLE001 - whatever it is, it becomes the warning
            client, broken = None, f"{type(e).__name__}: {e}"

        def ask(prompts: Sequence[str]) -> list[tuple[str | None, str | None]]:
            if broken is not None:
                return [(None, broken)] * len(prompts)
            try:
                answers = list(client(prompts))
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            except Exception as e:  # noqa: BLE001
                return [(None, f"{type(e).__name__}: {e}")] if len(prompts) == 1 else [x for p in prompts for x in ask([p])]
            return [(a, None) if a else (None, "empty answer") for a in answers]

        def predict(prompts: np.ndarray) -> dict[str, np.ndarray]:
            given = [i for i, p in enumerate(prompts) if p is not None]
            out: list[tuple[str | None, str | None]] = [(None, None)] * len(prompts)
            for i, x in zip(given, ask([prompts[i] for i in given]) if given else [], strict=True):
                out[i] = x
            return {"answer": np.array([a for a, _ in out], dtype=object), "warning": np.array([w for _, w in out], dtype=object)}

        return predict

    said = predict_batch_udf(make_predict, return_type=kind, batch_size=batch)(F.col(prompt))
    return df.withColumn("_said", said).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_said.answer").alias("answer"), F.col("_said.warning").alias("warning"))
