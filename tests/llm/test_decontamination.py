"""Decontamination: exact retrieval against scoring everything, and verified leaks."""

import random

import pytest

from reviewloom.llm import decontamination as dc


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n)]


def sentences(rng, words, n):
    return ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))) for _ in range(n)) + "."


def brute_scores(index, passage, threshold):
    terms = {index.vocabulary[w] for w in passage if w in index.vocabulary}
    score = [0.0] * len(index.ids)
    for t in terms:
        for k, x in index.postings(t):
            score[k] += x
    return {k for k, s in enumerate(score) if s >= threshold - 1e-9}


@pytest.mark.parametrize("block", [1, 3, 32])
def test_wand_retrieves_all_above_threshold(monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK", block)
    rng = random.Random(block)
    words = vocabulary(rng, 60)
    index = dc.build([(i, sentences(rng, words, rng.randint(2, 4))) for i in range(150)], 0.4)
    for _ in range(120):
        passage = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        terms = sorted({index.vocabulary[w] for w in passage if w in index.vocabulary})
        for threshold in (0.4, 0.6):
            got = dc.block_max_wand(index, terms, threshold)
            assert {k for k, _ in got} == brute_scores(index, passage, threshold) and len(got) == len({k for k, _ in got})


def brute_leaks(index, text, threshold):
    words = dc.words_of(text)
    names = list(index.vocabulary)
    out = set()
    for a, b in dc.windows(len(words), index.longest):
        for k in brute_scores(index, words[a:b], threshold):
            q, an = ([names[t] for t in part] for part in index.part(k))
            if dc.overlap(q, words[a:b]) >= dc.QUESTION_OVERLAP and dc.overlap(an, words[a:b]) >= dc.ANSWER_OVERLAP:
                out.add(k)
    return out


@pytest.mark.parametrize(("piece", "expanded"), [(dc.PIECE, dc.EXPANDED), (1, 1), (200, 50)])
def test_leaks_match_brute_force(monkeypatch, piece, expanded):
    monkeypatch.setattr(dc, "PIECE", piece)
    monkeypatch.setattr(dc, "EXPANDED", expanded)
    rng = random.Random(8)
    words = vocabulary(rng)
    items = [sentences(rng, words, rng.randint(1, 5)) for _ in range(80)]
    index = dc.build(list(enumerate(items)))
    texts = [None, "", "one"]
    for _ in range(150):
        t = [rng.choice(words) for _ in range(rng.randint(0, 500))]
        for _ in range(rng.randint(0, 2)):
            said = rng.choice(items).split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                said[rng.randrange(len(said))] = rng.choice(words)
            cut = rng.randint(0, len(t))
            t[cut:cut] = said[: rng.choice([len(said), len(said), len(said) * 2 // 3])]
        texts.append(" ".join(t))
    got = dc.leaks(index, texts)
    want = [brute_leaks(index, t, dc.THRESHOLD) for t in texts]
    assert [{x[0] for x in g} for g in got] == want
    assert sum(map(len, want)) > 40


def test_verbatim_items_are_always_found_and_prose_is_not():
    rng = random.Random(9)
    words = vocabulary(rng, 3000)
    items = [sentences(rng, words, 4) for _ in range(50)]
    index = dc.build(list(enumerate(items)))
    clean = [sentences(rng, words, 40) for _ in range(100)]
    assert not any(dc.leaks(index, clean))
    for i, item in enumerate(items):
        assert i in {x[0] for x in dc.leaks(index, [clean[i] + "\n" + item.upper() + " " + clean[i + 1]])[0]}


def test_operator(spark, monkeypatch):
    item = "which of the many colours has the old house. it is painted in a deep green"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (None, "two words"), (3, "what is the name of the river here in town. the small elbe")], "item_id long, text string")
    rows = [(1, "so " * 300 + item + " so" * 300), (2, None), (2, None), (None, item.replace(" ", "\n")), (5, ""), (6, "which of the many colours has the old house " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS leaks", "2 AS id")
    for chars in (dc.INDEX_CHARS, 60):
        monkeypatch.setattr(dc, "INDEX_CHARS", chars)
        out = [(r.doc_id, {x.item for x in r.leaks}) for r in dc.find_leaks(docs, items).collect()]
        assert sorted(out, key=repr) == sorted([(1, {1}), (2, set()), (2, set()), (None, {1}), (5, set()), (6, set())], key=repr)
        kept = dc.drop_leaking(docs, items)
        assert kept.columns == docs.columns and sorted(map(repr, [r.doc_id for r in kept.collect()])) == ["2", "2", "5", "6"]
    assert dc.find_leaks(docs, items.limit(0)).count() == 6
    assert dc.find_leaks(docs.limit(0), items).count() == 0


def test_short_items_leak_by_their_exact_run(spark):
    items = spark.createDataFrame([(1, "What is 17 times 3? 51"), (2, "one two three four five six seven eight nine ten"), (3, "Yes"), (4, "..."), (5, None)], "item_id long, text string")
    texts = ["So: what is 17 times 3?\n51, he said", "What is 17 times 4? 51", "one two three four five six seven eight nine ten. What is 17 times 3? 51", "oh yes", "yesterday", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x["item"] for x in r.leaks] for r in dc.find_leaks(docs, items).collect()}
    assert got == {0: [1], 1: [], 2: [1, 2], 3: [3], 4: [], 5: [], 6: []}
    assert sorted(r.doc_id for r in dc.drop_leaking(docs, items).collect()) == [1, 4, 5, 6]


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(12)) for _ in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, "other " + t.split(" ", 1)[1]) for i, t in enumerate(texts)], "doc_id long, text string")
    found = []
    for chars in (dc.INDEX_CHARS, 300):
        monkeypatch.setattr(dc, "INDEX_CHARS", chars)
        found.append({(r.doc_id, x["item"]): round(x["score"], 9) for r in dc.find_leaks(docs, items, 0.5).collect() for x in r.leaks})
    assert found[0] and found[0] == found[1]


def test_classes_of_length(spark):
    """Short, long and very long items, each found by a brute force over its own class."""
    rng = random.Random(21)
    words = vocabulary(rng, 3000)
    items = [sentences(rng, words, n) for n in (3, 3, 4, 20, 60, 700)]
    indexes = dc.indexes_of(list(enumerate(items)))
    assert [i.longest for i in indexes] == sorted(i.longest for i in indexes) and len(indexes) > 2
    texts = [sentences(rng, words, 30) + " " + items[k] + " " + sentences(rng, words, 30) for k in range(6)] + [sentences(rng, words, 300)]
    got = dc.all_leaks(indexes, texts)
    assert [[x[0] for x in g] for g in got] == [[0], [1], [2], [3], [4], [5], []]
    want = [{ix.ids[k] for ix in indexes for k in brute_leaks(ix, t, dc.THRESHOLD)} for t in texts]
    assert [{x[0] for x in g} for g in got] == want


def test_very_long_texts(spark):
    rng = random.Random(22)
    words = vocabulary(rng, 5000)
    item = sentences(rng, words, 4)
    long = " ".join(rng.choices(words, k=300_000))
    df = spark.createDataFrame([(1, long), (2, long + " " + item + " " + long)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [r.doc_id for r in dc.drop_leaking(df, items).collect()] == [1]
