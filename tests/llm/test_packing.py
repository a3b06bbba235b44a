"""Packing: every id once, sequences gapless, little padding, ids equal to the tokenizer's."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewloom.llm import packing


def tiled(pieces, lengths, size):
    """Checks a packing; returns the padding."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for d, start, n, s, at in pieces:
        assert n > 0
        docs[d].append((start, n))
        seqs[s].append((at, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, m in sorted(docs[d]):
            assert start == at
            at += m
        assert at == n
    pad = 0
    for parts in seqs.values():
        at = 0
        for start, m in sorted(parts):
            assert start == at
            at += m
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad


@pytest.mark.parametrize("seed", range(30))
def test_pack(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 64, 2048])
    lengths = [rng.choice([1, rng.randint(1, size), rng.randint(1, 4 * size)]) for _ in range(rng.randint(0, 120))]
    assert tiled(packing.pack(lengths, size), lengths, size) == 0


def test_ties_and_extremes():
    for lengths in ([1] * 5000, [2048] * 3, [2047] * 50, [100_000], [1025] * 40):
        assert tiled(packing.pack(lengths), lengths, 2048) == 0


def test_costs_are_balanced():
    lengths = [random.Random(1).randint(20, 900) for _ in range(600)]
    loads = defaultdict(float)
    for _, _, n, s, _ in packing.pack(lengths):
        loads[s] += packing.cost(n)
    full = sorted(loads.values())[3:]
    assert max(full) < 1.5 * np.mean(full)


TEXTS = [None, "", " ", "Hello, world.", "A.B,c.. it's we'll I'd.", "x\x1cy z w \u0085q", "é ́x ǅ Σ.ΑΣ, ß", "<|endoftext|> a <| b <|endoftext|>", "a\tb\r\nc", "٣,. 5. é. ,. '.", "q r.", "The the THE. " * 2000]


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    memo = packing.WordIds(t)
    for text in TEXTS * 2:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(memo.of(text), "<u4").tolist() == want, repr(text)[:50]


def test_letters_of_many_alphabets():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    memo = packing.WordIds(t)
    for c in range(0x21, 0x250):
        for w in (chr(c), f"a{chr(c)}", f"{chr(c)}B", f"A{chr(c)}."):
            assert np.frombuffer(memo.of(w), "<u4").tolist() == [*t.encode(w, add_special_tokens=False).ids, 1], (c, w)


def test_closing_punctuation():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    memo = packing.WordIds(t)
    for rest in ("", "a", "AB", "\u00e9", "e\u0301", "\u0130", "\u03a3", "\u01c5", "7", "it's", "'s", "x'", "<", "\u4e2d", "\u02b0"):
        for end in ("!!", "***", "$$$", "###", "&&&", "%%%", ",***", ".,", "!x", "$'s", "$'s.", "'!", "!7,", "%\u0338"):
            assert np.frombuffer(memo.of(rest + end), "<u4").tolist() == [*t.encode(rest + end, add_special_tokens=False).ids, 1], (rest, end)


def test_frequent_words_are_not_forgotten(monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "MEMO_WORDS", 8)
    words = ["".join(random.Random(k).choices("abcdefgh", k=9)) for k in range(200)]
    made = []

    class Counted:
        def tokenize(self, word):
            made.append(word)
            return t.model.tokenize(word)

    memo = packing.WordIds(t)
    memo.model = Counted()
    text = " ".join(f"often {w}" for w in words)
    assert memo.of(text) == packing.TextIds(t).of(text)
    assert made.count("often") == 1 and len(made) == 201
    assert len(memo) <= 8 and len(memo.older) <= 8


def test_query(spark, monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = TEXTS + ["some words here"] * 40
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)], "doc_id long, text string, start int, offset int")
    rows = packing.pack_documents(df).collect()
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    tiled([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], [len(x) for x in ids], 2048)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert packing.pack_documents(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "a b")] * 3, "doc_id long, text string")
    assert sum(r.length for r in packing.pack_documents(nulls).collect()) == 9


def plain_assignment(rests, lengths, bins, size):
    """Each rest by looking at all sequences."""
    put, used, spent = [[] for _ in range(bins)], [0] * bins, [0.0] * bins
    for n, d in rests:
        start = lengths[d] - n
        whole = [b for b in range(bins) if size - used[b] >= n]
        while n:
            # A rest that fits nowhere is cut over those with the most room.
            b = min(whole, key=lambda b: (spent[b], used[b], b)) if whole else min((b for b in range(bins) if used[b] < size), key=lambda b: (used[b] - size, spent[b], b))
            take = min(n, size - used[b])
            put[b].append((d, start, take))
            used[b] += take
            spent[b] += packing.LINEAR * take + packing.QUADRATIC * take * take
            start, n = start + take, n - take
    return put, used


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_the_plain_one(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 64, 2048])
    lengths = [rng.choice([1, rng.randint(1, size - 1), rng.randint(1, size // 4)]) for _ in range(rng.randint(1, 150))]
    rests = sorted(((n, d) for d, n in enumerate(lengths)), key=lambda x: (-x[0], x[1]))
    bins = -(-sum(lengths) // size)
    assert packing.assigned(rests, lengths, bins, size) == plain_assignment(rests, lengths, bins, size)


def test_any_tokenizers_file(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in packing.pack_documents(df, path).collect():
        ids = [*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_costs_of_all_sequences_vary_less_than_by_first_fit():
    """All sequences of a block, after the last moves too, against first fit of the same documents, longest first."""
    rng = random.Random(2)
    lengths = [min(1000, int(rng.lognormvariate(5, 0.8))) + 1 for _ in range(4000)]
    loads = defaultdict(float)
    for _, _, n, s, _ in packing.pack(lengths):
        loads[s] += packing.cost(n)
    used, spent = [], []
    for n in sorted(lengths, reverse=True):
        b = next((b for b, u in enumerate(used) if u + n <= 2048), len(used))
        if b == len(used):
            used.append(0)
            spent.append(0.0)
        used[b] += n
        spent[b] += packing.cost(n)
    full = [x for x, _ in sorted(zip(loads.values(), loads, strict=True))[12:]]
    assert np.std(full) < 0.5 * np.std(spent)
