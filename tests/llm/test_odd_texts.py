"""Texts that stall or crash a careless pattern: many line ends, an unbroken megabyte, long runs of blanks."""

import time

import pytest

import corpus_pipeline
from reviewloom.llm import decontamination, license_scan, line_dedup, quality_rules, simhash, suffix_tree
from reviewloom.llm.shared import table

SF = "/root/testdata/sf0.001"
NOTICE = "Released under the MIT License."
TEXTS = (
    NOTICE + "\n" * 200_000 + "end of text",
    NOTICE + "\n" + "7 " + "x" * 1_000_000,
    "a license 5" + " " * 200_000 + "b",
    NOTICE + "\nthe license\nof it\n\n" * 20_000,
    "word9 " * 200_000,
    "9" * 500_000 + "\n" + "-" * 500_000 + "\n" + "é" * 300_000,
)


@pytest.fixture(scope="module")
def odd(spark):
    docs = table(spark, SF, "documents")
    return spark.createDataFrame([(i, t, "en", "odd", len(t)) for i, t in enumerate(TEXTS)], docs.schema).repartition(3)


def taken(frame):
    began = time.monotonic()
    rows = frame.collect()
    return rows, time.monotonic() - began


@pytest.mark.parametrize("name", ["license", "lines", "rules", "simhash", "leaks", "suffix tree", *[s[0] for s in corpus_pipeline.STAGES]])
def test_within_seconds(spark, odd, name):
    run = dict(corpus_pipeline.STAGES).get(name) or {
        "license": lambda s, d, f: license_scan.scan_licenses(d, license_scan.known_digests(s)),
        "lines": lambda s, d, f: line_dedup.drop_recurring_lines(d),
        "rules": lambda s, d, f: quality_rules.apply_rules(d),
        "simhash": lambda s, d, f: simhash.near_duplicates(d, size=3, radius=2),
        "leaks": lambda s, d, f: decontamination.find_leaks(d, table(s, f, "benchmark")),
        "suffix tree": lambda s, d, f: suffix_tree.score(d),
    }[name]
    began = time.monotonic()
    rows = run(spark, odd, SF).collect()
    assert rows and time.monotonic() - began < 60


def test_licences_of_odd_texts(spark, odd):
    got = {r.doc_id: (r.license, r.n_notices) for r in license_scan.scan_licenses(odd, license_scan.known_digests(spark)).collect()}
    assert got == {0: ("MIT", 1), 1: ("MIT", 1), 2: (None, 0), 3: ("MIT", 1), 4: (None, 0), 5: (None, 0)}
