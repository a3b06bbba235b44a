"""Quality rules against plain Python measures."""

import random
import re

from pyspark.sql import functions as F

from reviewloom.llm import quality_rules as qr


def brute(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    cover = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, n_words int")
    return {r["doc_id"]: r for r in qr.apply_rules(df, **more).collect()}


def test_measures(spark):
    rng = random.Random(5)
    texts = [None, "", "  \n\t ", "a", "a b c d e a b c d e", "a a a a a a a", " x y #|>", "x\x1cy\x0bz", "q\nq\n \n \nq", "\U0001f600é w" * 3, "word " * 30_000 + "end"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        n, wc, sy, dl, rep = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, wc, sy, dl, rep), repr(t)[:80]
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def test_verdicts_do_not_depend_on_the_order(spark):
    prose = "Thand is the onhe rehe and reon estied in that anntnd hely thingst with hable."
    texts = [prose, prose.upper(), prose.replace(" ", "*** "), prose.replace(" ", "\n") + "\nis" * 9, prose + " " + "x" * 1500, prose.replace(" ", " a b ")]
    first = {k: v.kept for k, v in run(spark, texts).items()}
    assert first == {k: v.kept for k, v in run(spark, texts, rules=qr.RULES[::-1]).items()}
    assert first[0] and not first[1] and not first[2] and not first[4]


def test_cheap_and_selective_rules_come_first(spark):
    rows = qr.measured(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("w " * 20).alias("text"))).withColumns({"base_failed": F.lit(False)})
    never, half, rest = qr.Rule("never", lambda: F.lit(False) & (F.col("doc_id") < 0)), qr.Rule("half", lambda: F.col("doc_id") < 100), qr.Rule("same", lambda: F.col("doc_id") < 90)
    order = qr.order_rules(rows, [never, rest, half])
    names = [r.name for r, _, _ in order]
    assert names.index("never") > 0 and {r.name: s for r, _, s in order}["never"] == 0
    # What an earlier rule has rejected no longer counts for a later one.
    assert dict((r.name, s) for r, _, s in order)[max(("half", "same"), key=names.index)] in (0.0, 10 / 110)


def test_empty_and_repeats(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e f g h i j k")] * 3, "doc_id long, text string")
    assert qr.apply_rules(df).count() == 3


def test_id_of_any_name(spark):
    for name in ("text", "n_words", "kept"):
        df = spark.createDataFrame([(7, "a b c d e f g h i j k")], f"{name} long, body string")
        out = qr.apply_rules(df, id_col=name, text_col="body")
        assert out.columns[0] == name and len(set(out.columns)) == len(out.columns) and out.first()[0] == 7


def test_the_sample_is_bounded_and_the_order_stays(spark):
    df = spark.range(0, 60_000, 1, 13).select(F.col("id").alias("doc_id"), F.concat(F.lit("word " * 12), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " $$$ # # # # #").otherwise("")).alias("text"))
    assert 1_300 < qr.sampled(df, 2_000).count() <= 2_000 and qr.sampled(df.limit(50), 2_000).count() == 50
    orders = set()
    for _ in range(10):
        sample = qr.measured(qr.sampled(df, 500))
        orders.add(tuple(r.name for r, _, _ in qr.order_rules(sample, qr.RULES)))
    assert len(orders) == 1 and next(iter(orders))[0] == "symbols"


def test_each_rule_rejects_what_it_is_for(spark):
    prose = "Thand is the onhe rehe and reon estied in that anntnd hely thingst with hable"
    texts = {
        "numbers": " ".join(str(10**7 + i) for i in range(20)) + " and some words",
        "bullets": "\n".join(f"{m} item {w} of {w}" for m, w in zip("-*\u2022-*", ("one", "two", "three", "four", "five"), strict=True)),
        "ellipses": "\n".join(f"{w} goes {w} on..." for w in prose.split()),
        "unbroken": prose + " " + "x" * 1001,
    }
    for name, text in texts.items():
        got = run(spark, [text, prose], rules=[r for r in qr.RULES if r.name == name])
        assert not got[0].kept and not got[0].base_failed and got[1].kept, name
