"""Quality classifier: ordinal cumulative-link regression over hashed text.

Ratings are ordered grades 0, 1, 2, ... One weight vector over hashed tokens is
shared by all grades; ordered thresholds turn the score into cumulative
probabilities P(grade <= k) = sigmoid(threshold_k - score). A document gets its
expected grade and the probability of its upper tail, by which it is selected.

The model is fitted on a bounded sample of labelled rows (``max_rows``, taken in
the order of a hash of their ids, so it does not depend on the layout); every
row is scored. Only buckets whose documents are graded significantly lower than
the mean of the sample get a weight: a text is judged by what speaks against it,
so long texts do not add up noise, and short ones are not rejected for what they
lack.

Nulls and odd input: a null text scores like an empty one. Labels with a null, or
outside of the grades, are left out; of several labels of an id the lowest grade
counts. Without labels of at least two grades there is nothing to learn: all
documents get the only grade known (or the highest) and are kept. Null ids and repeated rows are scored like any other row.
An empty table gives an empty result. Other columns are not read. Texts of any
length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import filter_in_arrow, written

#: Buckets that tokens are hashed to.
BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 10_000
#: A bucket is a candidate from this many documents of the sample on.
MIN_DOCUMENTS = 4
#: Unrelated buckets that may pass the screening, about.
FALSE_BUCKETS = 20
#: Strength of the weights' penalty, and steps of the fit.
PENALTY, STEPS = 0.05, 1000
#: Tokens: runs of letters, and runs of one other visible character kind.
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _steps(name: str, part: int, whole: int) -> list[str]:
    """Tokens for each tenth that ``part`` reaches of ``whole``."""
    return [f"\0{name}{k}" for k in range(1, 10 * part // whole + 1)] if whole else []


def tokens_of(text: str | None) -> set[str]:
    """The distinct tokens of a text: words, other characters also by doublings of their count, and the shares of
    capitals and of words that repeat the word before."""
    t = text or ""
    words = t.split()
    found = Counter(_TOKEN.findall(t.lower()))
    out = set(found)
    for w, n in found.items():
        if not w[0].isalpha():
            out.update(f"{w[:8]}\0{k}" for k in range(1, n.bit_length()))
    out.update(_steps("caps", len(_CAPITAL.findall(t)), max(20, sum(map(len, words)))))
    out.update(_steps("again", sum(map(str.__eq__, words, words[1:])), max(10, len(words))))
    return out


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score, a column for each grade."""
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - score[:, None], -40, 40)))
        return np.diff(np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))]), axis=1)


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n)


def screened(have: np.ndarray, graded: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Which buckets speak against a text: their documents' mean grade is below the mean of all, beyond chance.

    ``have`` and ``graded`` are the number of a bucket's documents and the sum of their
    grades, ``present`` the documents of each grade. Once screened, the buckets that are
    left pass again.
    """
    grades, n = np.arange(len(present)), present.sum()
    mean = (grades * present).sum() / n
    deviation = ((grades - mean) ** 2 * present).sum() / n
    z = (mean - graded / np.maximum(have, 1)) * np.sqrt(have / max(deviation, 1e-9))
    enough = have >= MIN_DOCUMENTS
    return enough & (z >= np.sqrt(2 * np.log(max(enough.sum() / FALSE_BUCKETS, 2))))


def fit(buckets: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Model:
    """The model for documents given as their distinct buckets."""
    n = len(grades)
    present = np.bincount(grades, minlength=n_grades) if n else np.zeros(n_grades)
    if (present > 0).sum() < 2:
        only = int(grades[0]) if n else n_grades - 1
        return Model({}, [-40.0 if k < only else 40.0 for k in range(n_grades - 1)])
    rows = np.repeat(np.arange(n), [len(b) for b in buckets])
    cols = np.concatenate(buckets) if n else np.zeros(0, np.int64)
    seen, inverse = np.unique(cols, return_inverse=True)
    have = np.bincount(inverse, minlength=len(seen))
    used = screened(have, _sums(grades.astype(float)[rows], inverse, len(seen)), present)
    place = np.cumsum(used) - 1
    keep = used[inverse]
    rows, cols, width = rows[keep], place[inverse[keep]], int(used.sum())

    # Thresholds are the first and then the logs of their steps, so they stay ordered.
    share = np.clip(np.cumsum(present)[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    # No grade drowns in the most frequent one.
    weight = 1 / np.sqrt(present[grades])
    weight /= weight.sum()

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])

    m = v = np.zeros(len(params))
    for step in range(1, STEPS + 1):
        w, cut = params[:width], thresholds(params)
        score = _sums(w[cols], rows, n)
        edge = np.hstack([np.full((n, 1), 0.0), 1 / (1 + np.exp(-np.clip(cut[None, :] - score[:, None], -40, 40))), np.full((n, 1), 1.0)])
        hi, lo = edge[np.arange(n), grades + 1], edge[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-9)
        slope_hi, slope_lo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        g_score = slope_hi - slope_lo
        g_cut = np.array([-(slope_hi[grades == k].sum() - slope_lo[grades == k + 1].sum()) for k in range(n_grades - 1)])
        grad = np.concatenate([_sums(g_score[rows], cols, width) + PENALTY * w / max(width, 1), [g_cut.sum()], [g_cut[k:].sum() * np.exp(params[width + k]) for k in range(1, n_grades - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = params[:width]
    return Model({int(c): float(x) for c, x in zip(seen[used], w, strict=True)}, thresholds(params).tolist())


def quality_grade(quality: Column, toxic: Column) -> Column:
    """Grade 2 for good and clean, 1 for one of both, 0 for neither; null for other labels."""
    return F.when(quality.isin(0, 1) & toxic.isin(0, 1), quality + (1 - toxic)).cast("int")


def training_rows(df: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str) -> list[tuple[np.ndarray, int]]:
    """(distinct buckets that pass the screening, grade) of at most ``max_rows`` labelled documents; ``labels`` is (id, grade).

    Buckets are counted by executors. The driver gets two numbers of each bucket in
    ``MIN_DOCUMENTS`` rows or more, and then of each row the buckets that have passed.
    """
    rated = labels.where("grade IS NOT NULL").groupBy(id_col).agg(F.min("grade").alias("grade"))
    # The sample's ids are bounded by max_rows.
    picked = rated.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = df.select(id_col, text_col).join(F.broadcast(picked), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique([bucket(w) for w in tokens_of(t.as_py())]).astype(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f.tobytes() for f in found], pa.binary())], ["id", "grade", "buckets"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, graded = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for grade, packed in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                mine = np.frombuffer(packed.as_py(), np.int32)
                have[mine] += 1
                graded[mine] += grade
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some, have[some], graded[some])], ["bucket", "have", "graded"])

    id_type = df.schema[id_col].dataType.simpleString()
    hashed = rows.mapInArrow(run, f"id {id_type}, grade int, buckets binary")
    sample = written(hashed.groupBy("id").agg(F.first("grade").alias("grade"), F.min("buckets").alias("buckets")).orderBy("id").limit(max_rows), "training-rows")
    present = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    if not present:
        return []
    counts = sample.mapInArrow(count, "bucket long, have long, graded long").groupBy("bucket").agg(F.sum("have").alias("have"), F.sum("graded").alias("graded"))
    told = counts.where(F.col("have") >= MIN_DOCUMENTS).toArrow()
    place, have, graded = (told.column(c).to_numpy() for c in ("bucket", "have", "graded"))
    used = np.sort(place[screened(have, graded.astype(float), np.array([present.get(g, 0) for g in range(max(present) + 1)]))])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x.as_py(), np.int32) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[np.isin(f, used)].tobytes() for f in found], pa.binary())], ["id", "grade", "buckets"])

    left = sample.mapInArrow(passing, f"id {id_type}, grade int, buckets binary").orderBy("id")
    return [(np.frombuffer(r.buckets, np.int32).astype(np.int64), r.grade) for r in left.collect()]


def classify(
    df: DataFrame,
    labels: DataFrame,
    n_grades: int = 3,
    tail: int = 2,
    least: float = 0.7,
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    drop_rejected: bool = False,
) -> DataFrame:
    """(id, expected_grade, tail_probability, kept) for each row; or, to drop the rejected, the kept rows themselves.

    ``labels`` is (id, grade). ``tail_probability`` is that of ``tail`` or a higher
    grade; a document is kept if it is at least ``least`` times that of a text that
    nothing speaks against.
    """
    rows = training_rows(df, labels, max_rows, id_col, text_col)
    model = fit([b for b, _ in rows], np.array([g for _, g in rows], np.int64), n_grades)
    text_at = df.columns.index(text_col) if drop_rejected else 1
    grades = np.arange(n_grades)
    bar = least * float(model.probabilities(np.zeros(1))[0, tail:].sum())

    def scorer() -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
        """Expected grades and tail probabilities of texts, with a memory of tokens."""
        memo: dict[str, float] = {}
        weights = model.weights

        def weight(token: str) -> float:
            if (w := memo.get(token)) is None:
                w = weights.get(bucket(token), 0.0)
                if len(memo) > 300_000:
                    memo.clear()
                memo[token] = w
            return w

        def scored(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            # A bucket counts once in a text, as in training; used buckets are few, so collisions within a text hardly matter.
            p = model.probabilities(np.array([sum(map(weight, tokens_of(t.as_py()))) for t in texts]))
            return p @ grades, p[:, tail:].sum(axis=1)

        return scored

    if drop_rejected:
        made: list[Callable] = []

        def stays(b: pa.RecordBatch) -> pa.Array:
            if not made:
                made.append(scorer())
            return pa.array(made[0](b.column(text_at))[1] >= bar)

        return filter_in_arrow(df, stays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = scorer()
        for b in batches:
            expected, above = scored(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(above), pa.array(above >= bar)], ["id", "expected_grade", "tail_probability", "kept"])

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, expected_grade double, tail_probability double, kept boolean")
    return out.withColumnRenamed("id", id_col)
