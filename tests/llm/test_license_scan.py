"""License scans on small texts."""

import textwrap

from pyspark.sql import functions as F

from reviewloom.llm import license_scan as ls

APACHE = "Licensed under the Apache License, Version 2.0."


def scanned(spark, texts, known=ls.KNOWN):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, license string, digest string")
    out = ls.scan_licenses(df, ls.known_digests(spark, known))
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def test_whole_texts_and_lines(spark):
    got = scanned(
        spark,
        [
            APACHE,
            "(c) 2020 A. Person\n LICENSED  under the apache licence version 2.0\nAll rights reserved.",
            "Words.\nReleased under the MIT licence!\n" + APACHE,
            "A text that mentions that it is " + APACHE,
            "Éa " + APACHE,
            None,
            "",
            "Copyright 2020",
            ("long words " * 50_000) + "\n" + APACHE,
            APACHE + "\n" + APACHE,
        ],
    )
    assert got[0] == ("Apache-2.0", "text", 1)
    assert got[1] == ("Apache-2.0", "text", 1)
    assert got[2] == ("Apache-2.0;MIT", "line", 2)
    assert got[8] == ("Apache-2.0", "line", 1)
    assert got[9] == ("Apache-2.0", "line", 2)
    assert all(got[i] == (None, None, 0) for i in (3, 4, 5, 6, 7))


def test_repeats_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, APACHE)] * 3 + [(7, "x")], "doc_id long, text string")
    out = ls.scan_licenses(df, ls.known_digests(spark)).collect()
    assert sum(r["doc_id"] is None and r["license"] == "Apache-2.0" for r in out) == 3 and len(out) == 4
    assert scanned(spark, []) == {}
    assert scanned(spark, [APACHE], known=())[0] == (None, None, 0)


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, APACHE)], "doc_id long, text string")
    plan = ls.scan_licenses(df, ls.known_digests(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "CartesianProduct"))


def test_full_texts_and_wrapped_headers(spark):
    mit = "MIT License\n\nCopyright (c) 2021 A. Person\n\n" + "\n\n".join(textwrap.fill(p, 78) for p in (ls._MIT, *ls._MIT_REST.split("\n\n")))
    apache = "# Copyright 2021 A. Person\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n#\n# more words"
    gpl = " * A program\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License, version 3.\n *\n * end"
    texts = [mit, "Words.\n\n" + mit + "\n\nWords.", apache, gpl, "words\n\n(c) 2020 A. Person\n" + APACHE + "\n\nwords"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in ls.scan_licenses(df, ls.known_digests(spark)).collect()}
    assert got == {0: ("MIT", "text", 1), 1: ("MIT", "line", 1), 2: ("Apache-2.0", "line", 1), 3: ("GPL-3.0", "line", 1), 4: ("Apache-2.0", "line", 1)}


def plain_canonical(text):
    """Word by word, without the module's patterns."""
    kept = []
    for line in text.split("\n"):
        low = line.lower().lstrip(" \t#*/-;%")
        year = any(low[i : i + 4].isdigit() for i in range(len(low) - 3))
        signed = low.startswith("\u00a9") or low.startswith("all rights reserved") or (low.startswith("copyright") and (low[9:].strip().startswith(("(c)", "\u00a9")) or year))
        if not signed:
            kept.append(line)
    words = "".join(c if c.isalnum() else " " for c in "\n".join(kept).lower()).split()
    for old, new in ls.SPELLINGS:
        old, new = old.split(), new.split()
        i = 0
        while i < len(words):
            if words[i : i + len(old)] == old:
                words[i : i + len(old)] = new
                i += len(new)
            else:
                i += 1
    return " ".join(words)


def test_canonical_form_does_not_depend_on_the_wrap(spark):
    texts = []
    for license, body in ls.TEXTS:
        for width in (40, 60, 79, 1000):
            texts.append((license, "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p, width) for p in body.strip().split("\n\n"))))
    texts.append(("sublicense", "licence licence sub licence sub-licence acknowledgement  acknowledgement"))
    df = spark.createDataFrame(texts, "license string, body string").select("license", "body", ls.canonical(F.col("body")).alias("c"))
    for r in df.collect():
        assert r.c == plain_canonical(r.body), r.body
    forms = {}
    for r, (_, body) in zip(df.collect(), [t for t in ls.TEXTS for _ in range(4)], strict=False):
        forms.setdefault(body, set()).add(r.c)
    assert all(len(f) == 1 for f in forms.values())


def test_words_of_chained_spellings_are_looked_for(spark):
    got = scanned(spark, ["you may sub licence it"], known=(("X", "You may sublicense it."),))
    assert got[0] == ("X", "text", 1)
