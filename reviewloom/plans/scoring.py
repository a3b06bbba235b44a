"""Queries: prompts, parsed generations, scores and the release gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions.text import ecosystem_hint, parse_finding, prompt, target
from reviewloom.operators import evaluate
from reviewloom.plans.views import SQL, predictions
from reviewloom.sources.tables import table

FLOOR = 0.1


def _hint():
    k = F.col("doc_id")
    return ecosystem_hint(F.when(k % 2 == 0, "nestjs"), F.when(k % 3 == 0, "").otherwise("zod"), F.when(k % 5 == 0, "postgres"))


def prompt_hint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _hint().alias("hint"))


def prompt_render(spark, sf):
    text = prompt(F.lit("python"), _hint(), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("chars"))


def target_render(spark, sf):
    return table(spark, sf, "labels").select("doc_id", target(F.lit("bug"), F.col("quality").cast("string"), F.lit("likely"), F.concat(F.lit("{summary} "), F.col("toxic").cast("string"))).alias("target"))


def _parsed(spark, sf):
    return predictions(spark, sf).select("doc_id", "expected", parse_finding(F.col("generated")).alias("p")).select("doc_id", "expected", "p.*")


def parse_finding_fields(spark, sf):
    return _parsed(spark, sf).select("doc_id", "category", "severity", "confidence", "summary")


def parse_last_wins(spark, sf):
    return _parsed(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(spark, sf):
    return evaluate.confusion_counts(_parsed(spark, sf), "expected", "category")


def category_prf(spark, sf):
    out = evaluate.category_scores(confusion_counts(spark, sf))
    return out.select("category", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def macro_f1(spark, sf):
    return evaluate.macro_f1(evaluate.category_scores(confusion_counts(spark, sf))).select(F.round("macro_f1", 9).alias("macro_f1"))


def regression_gate(spark, sf):
    score = evaluate.macro_f1(evaluate.category_scores(confusion_counts(spark, sf)))
    gate = lambda previous: evaluate.regression_gate(F.col("macro_f1"), F.lit(previous).cast("double"), FLOOR)
    return score.select(gate(None).alias("first_release"), gate(0.05).alias("after_lower"), gate(0.99).alias("after_higher"))


def eval_report(spark, sf):
    """One row for each category beside the totals of the report."""
    scores = evaluate.category_scores(confusion_counts(spark, sf))
    # Each example is a hit or a miss of its expected category.
    total = scores.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.sum(F.col("tp") + F.col("fn")), F.lit(0)).alias("examples"))
    # Both sides are bounded: one row of totals, and a row for each category.
    return scores.crossJoin(F.broadcast(total)).select("category", "tp", "fp", "fn", F.round("f1", 9).alias("f1"), F.round("macro_f1", 9).alias("macro_f1"), F.col("examples").cast("long").alias("examples"))


def paired_predictions(spark, sf):
    rows = _parsed(spark, sf).select(F.col("doc_id").alias("row_id"), "expected", F.col("category").alias("predicted"))
    both = evaluate.paired(rows.select("row_id", "predicted"), rows.select("row_id", "expected"))
    return both.groupBy((F.col("predicted") == F.col("expected")).alias("right")).agg(F.count(F.lit(1)).alias("n"))


def _by_length():
    """A predictor whose category follows from the length of the prompt."""
    return lambda prompts: [f"Category: {('security', 'bug', 'testing')[len(p) % 3]}\nsummary: x" for p in prompts]


evaluate.register_predictor("by_length", _by_length)


def evaluation_run(spark, sf):
    """Prompts of labelled documents through a registered predictor, scored by category."""
    prompts = prompt(F.lit("python"), _hint(), F.col("text")).alias("prompt")
    labelled = predictions(spark, sf).select("doc_id", "expected").join(table(spark, sf, "documents").select("doc_id", prompts), "doc_id")
    got = evaluate.generated(labelled, "by_length").select("expected", parse_finding(F.col("generated"))["category"].alias("predicted"))
    return evaluate.confusion_counts(got)


QUERIES = {
    f.__name__: f
    for f in (prompt_hint, prompt_render, target_render, parse_finding_fields, parse_last_wins, confusion_counts, category_prf, macro_f1, regression_gate, eval_report, paired_predictions, evaluation_run)
}

_HINT = "CASE WHEN doc_id % 2 = 0 OR doc_id % 3 <> 0 OR doc_id % 5 = 0 THEN ' (using ' || array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'nestjs' END, CASE WHEN doc_id % 3 <> 0 THEN 'zod' END, CASE WHEN doc_id % 5 = 0 THEN 'postgres' END], lambda x: x IS NOT NULL), ', ') || ')' ELSE '' END"
_PROMPT = (
    "'### Task' || chr(10) || 'Review the following python code' || " + _HINT + " || '. Identify the single most' || chr(10) || 'important finding: its category, severity, confidence, and a one-sentence' || chr(10) || 'summary.' "
    "|| chr(10) || chr(10) || '### Code' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || '### Finding' || chr(10)"
)
_SCORED = f"""WITH {SQL["predictions"]},
v AS (SELECT expected AS category, 1 AS tp, 0 AS fp, 0 AS fn FROM predictions WHERE expected = predicted
  UNION ALL SELECT expected, 0, 0, 1 FROM predictions WHERE predicted IS DISTINCT FROM expected
  UNION ALL SELECT predicted, 0, 1, 0 FROM predictions WHERE predicted <> expected),
c AS (SELECT category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM v GROUP BY 1),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM c),
s AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""

ORACLES = {
    "prompt_hint": f"SELECT doc_id, {_HINT} AS hint FROM documents",
    "prompt_render": f"SELECT doc_id, sha256({_PROMPT}) AS sha, length({_PROMPT}) AS chars FROM documents",
    "target_render": "SELECT doc_id, 'category: bug' || chr(10) || 'severity: ' || quality || chr(10) || 'confidence: likely' || chr(10) || 'summary: {summary} ' || toxic || chr(10) AS target FROM labels",
    "parse_finding_fields": f"WITH {SQL['predictions']} SELECT doc_id, predicted AS category, CASE WHEN n_chars >= 600 THEN 'high' END AS severity, NULL::VARCHAR AS confidence, CASE WHEN n_chars >= 600 THEN n_chars::VARCHAR END AS summary FROM predictions",
    "parse_last_wins": f"WITH {SQL['predictions']} SELECT predicted AS category, count(*) AS n FROM predictions GROUP BY 1",
    "confusion_counts": f"{_SCORED} SELECT category, tp, fp, fn FROM c",
    "category_prf": f"{_SCORED} SELECT category, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM s",
    "macro_f1": f"{_SCORED} SELECT round(coalesce(avg(f1), 0.0), 9) AS macro_f1 FROM s",
    "regression_gate": f"{_SCORED}, m AS (SELECT coalesce(avg(f1), 0.0) AS x FROM s) SELECT x >= {FLOOR} AS first_release, x >= {FLOOR} AND x >= 0.05 AS after_lower, x >= {FLOOR} AND x >= 0.99 AS after_higher FROM m",
    "eval_report": f"{_SCORED} SELECT category, tp, fp, fn, round(f1, 9) AS f1, round(avg(f1) OVER (), 9) AS macro_f1, (SELECT count(*) FROM predictions) AS examples FROM s",
    "evaluation_run": f"""WITH {SQL["predictions"]}, p AS (SELECT q.expected, ['security', 'bug', 'testing'][length({_PROMPT}) % 3 + 1] AS predicted FROM documents JOIN (SELECT doc_id AS id, expected FROM predictions) q ON doc_id = id),
v AS (SELECT expected AS category, 1 AS tp, 0 AS fp, 0 AS fn FROM p WHERE expected = predicted UNION ALL SELECT expected, 0, 0, 1 FROM p WHERE expected <> predicted UNION ALL SELECT predicted, 0, 1, 0 FROM p WHERE expected <> predicted)
SELECT category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM v GROUP BY 1""",
    "paired_predictions": f"WITH {SQL['predictions']} SELECT predicted = expected AS right, count(*) AS n FROM predictions GROUP BY 1",
}
