"""The pipeline, stage by stage, against brute-force versions of the stages."""

import importlib.util
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from reviewloom.llm import decontamination as dc
from reviewloom.llm import packing
from reviewloom.llm import quality_classifier as qc
from reviewloom.llm.queries import graded_labels
from reviewloom.llm.shared import table
from reviewloom.sources import scratch

SF = "/root/testdata/sf0.001"


def sibling(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF), "test")
        out.append(docs.collect())
    return out


def test_names_and_columns(spark, stages):
    assert [len(s) > 0 for s in stages] == [True] * 6
    want = table(spark, SF, "documents").columns
    assert all(list(s[0].__fields__) == want for s in stages[:5])


def test_quality(spark, stages):
    rows = qc.training_rows(table(spark, SF, "documents"), graded_labels(spark, SF), qc.MAX_ROWS, "doc_id", "text")
    m = qc.fit([b for b, _ in rows], np.array([g for _, g in rows]), 3)
    tail = lambda s: float(m.probabilities(np.array([s]))[0, 2])
    want = [r for r in stages[0] if tail(sum(m.weights.get(qc.bucket(t), 0.0) for t in qc.tokens_of(r.text))) >= 0.7 * tail(0.0)]
    assert sorted(stages[1]) == sorted(want) and len(want) < len(stages[0])


def test_lines(spark, stages):
    t = sibling("test_line_dedup")
    texts = [r.text for r in stages[1]]
    kept = t.brute(texts)
    want = sorted((r.doc_id, k, r.lang, r.source, len(k)) for r, k in zip(stages[1], kept, strict=True) if k.split() or k == r.text)
    assert sorted(map(tuple, stages[2])) == want


def test_near_duplicates(stages):
    t = sibling("test_simhash")
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    sets = [t.shingles(r.text) for r in rows]
    root = t.brute_groups(range(len(rows)), lambda a, b: t.alike(sets[a], sets[b]))
    want = sorted(rows[i] for i in set(root.values()))
    assert sorted(stages[3]) == want and len(want) < len(rows)


def test_clashing_columns(spark):
    texts = [f"plain words number {i} of a text with nothing odd in it at all" for i in range(6)]
    rows = [(i, t, "en", "a", len(t), 7, 8, 1, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text_key int, text_key int, row int, `stay.id` string")
    for _, stage in cp.STAGES[:4]:
        assert sorted(stage(spark, docs, SF).collect()) == sorted(docs.collect())
    assert cp.pack(spark, docs, SF).count() >= 6


def test_decontamination(spark, stages):
    indexes = dc.indexes_of([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    t = sibling("test_decontamination")
    assert sorted(stages[4]) == sorted(r for r in stages[3] if not any(t.brute_leaks(i, r.text, dc.THRESHOLD) for i in indexes))


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4]}
    ids = sorted(docs)
    pieces = [(ids.index(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in stages[5]]
    assert sibling("test_packing").tiled(pieces, [docs[i] for i in ids], packing.LENGTH) == 0


def test_only_the_last_input_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = cp.run(spark, SF)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["reviewloom-benchmark-decontamination"]
    assert out.count() > 0


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted({(r.doc_id, r.doc_tokens) for r in stages[5]})


def test_null_and_repeated_documents(spark):
    kind = table(spark, SF, "documents").schema
    words = "some plain words of a text that is repeated over and over in this very small table of ours"
    rows = [(None, words, None, None, 1), (None, words, None, None, 1), (5, words, "en", "a", 1), (5, words, "en", "a", 1), (6, None, None, None, None), (7, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, kind)
    left = cp.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.text or "" for r in left) == ["", words]
    assert cp.lines(spark, docs, SF).count() == 6
    assert cp.decontaminate(spark, docs, SF).count() == 6
    empty = docs.where(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
