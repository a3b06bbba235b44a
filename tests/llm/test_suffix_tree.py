import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import queries, suffix_tree
from reviewloom.llm.suffix_tree import Settings

SCHEMA = "doc_id long, text string"


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def brute(rows, settings):
    """The suffix tree over plain dictionaries: (held_out, n_tokens, n_known, train_tokens, base, score) of each row."""
    texts = [(i is not None and zlib.crc32(str(i).encode()) % 10 == 0, tokens_of(t)) for i, t in rows]
    training = [t for held, t in texts if not held]
    follows = {}
    for t in training:
        for i, w in enumerate(t):
            for depth in range(min(i, settings.depth) + 1):
                follows.setdefault(tuple(t[i - depth : i]), Counter())[w] += 1
    words = follows.get((), Counter())
    total = sum(words.values())
    states, gains = {()}, {}

    def chance(context, w):
        """By the longest suffix that is a state; the tree is closed under suffixes."""
        if not context:
            return (words[w] + 0.1) / (total + 0.1 * (len(words) + 1))
        suffix = chance(context[1:], w)
        if context not in states:
            return suffix
        c = follows[context]
        return (c[w] + settings.prior * suffix) / (sum(c.values()) + settings.prior)

    for depth in range(1, settings.depth + 1):
        for context, c in follows.items():
            n = sum(c.values())
            if len(context) == depth and n >= max(settings.min_count, settings.min_share * total) and context[1:] in states:
                gain = sum(k * math.log10((k - 1 + settings.prior * chance(context[1:], w)) / (n - 1 + settings.prior) / chance(context[1:], w)) for w, k in c.items())
                gains[context] = gain / n - settings.gain
        states |= {x for x, g in gains.items() if len(x) == depth and g >= 0}
    assert all(abs(g) > 1e-9 for g in gains.values())
    out = []
    for held, t in texts:
        score = sum(math.log10(chance(tuple(t[max(0, i - settings.depth) : i]), w)) for i, w in enumerate(t))
        out.append((held, len(t), sum(words[w] > 0 for w in t), total, sum(math.log10(chance((), w)) for w in t), score))
    return out, states


def same(got, rows, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *[round(x, 6) for x in r[1:]])
    got = sorted((tuple(r) for r in got), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, states = brute(rows, Settings())
    assert len(states) > 10
    got = queries.op12_suffix_tree(spark, sf)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), rows, want)


@pytest.mark.parametrize("settings", [Settings(min_count=3, gain=0.02, prior=2.0, chunk=7, bucket_keys=5), Settings(depth=3, min_count=2, gain=-0.05, prior=1.5, chunk=50, bucket_keys=100), Settings(depth=1, min_count=4, chunk=10_000), Settings(min_count=2, min_share=0.02, gain=0.0, prior=2.0, chunk=100)])
def test_cut_texts_and_many_buckets(spark, settings):
    rows = [(i, " ".join(["the Cat sat", "on a mat", "A Dog ran\tto the mat", "x\x0by  z"][j % 4] for j in range(i % 7))) for i in range(90)]
    rows += [(200 + i, "Same words here the cat sat") for i in range(45)] + [(i, None) for i in range(300, 303)]
    rows += [(None, "the cat sat"), (None, ""), (5, "the dog"), (5, "the dog"), (400, "many Words " * 100 + "end")]
    want, states = brute(rows, settings)
    assert max(map(len, states)) == settings.depth
    same(suffix_tree.score(spark.createDataFrame(rows, SCHEMA).repartition(3), settings=settings).collect(), rows, want)


def test_tables_without_training_or_rows(spark):
    assert suffix_tree.score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = suffix_tree.score(spark.createDataFrame([(held, "a b")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_string_ids_and_clashing_names(spark):
    rows = [("x", "a b a b"), ("y", "a b"), (None, None)]
    df = spark.createDataFrame(rows, "score string, text string").withColumn("row", F.lit(1)).withColumn("held", F.lit("x"))
    got = suffix_tree.score(df, id_col="score")
    assert got.columns[0] == "score" and got.columns[-1] == "_score" and got.count() == 3


def test_better_than_the_base_on_held_out_texts(spark):
    got = queries.op12_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out")
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_long_text_is_read_in_slices(monkeypatch):
    text = "Ab\x0b cd e " * 50
    whole = [w for part in suffix_tree._words(text) for w in part]
    monkeypatch.setattr(suffix_tree, "_SLICE", 7)
    assert [w for part in suffix_tree._words(text) for w in part] == whole == [w.encode() for w in tokens_of(text)[:-1]]
