"""SimHash fingerprints, index and components against brute force."""

import random
import time

import numpy as np
import pytest
import xxhash

from reviewloom.llm import shared, simhash
from reviewloom.llm.shared import written


def brute_print(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(nodes, linked):
    """Root (smallest) of each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    ns = sorted(nodes)
    for i, a in enumerate(ns):
        for b in ns[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def clustered(rng, n, bits, flips):
    out = set()
    while len(out) < n:
        c = rng.getrandbits(bits)
        for _ in range(rng.randint(1, 12)):
            out.add(c)
            for _ in range(rng.randint(1, flips)):
                c ^= 1 << rng.randrange(bits)
    return sorted(out)[:n]


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b", "One TWO three four", "É é \x1c x", "w " * 3000])
@pytest.mark.parametrize("size", [3, 5])
def test_fingerprints(text, size):
    assert simhash.fingerprint(text, size) == [brute_print(text, size)]


def test_local_links_match_brute_force():
    rng = random.Random(1)
    codes = np.array(clustered(rng, 700, 64, 2), np.uint64)
    group = np.sort(np.array([rng.randrange(9) for _ in codes]))
    labels = simhash.local_links(codes, group, 2)
    root = brute_groups(range(700), lambda a, b: group[a] == group[b] and int(codes[a] ^ codes[b]).bit_count() <= 2)
    assert [root[i] for i in range(700)] == labels.tolist()


@pytest.mark.parametrize("node_rows", [2, 4096])
def test_index_loses_no_link(spark, node_rows):
    rng = random.Random(2)
    codes = clustered(rng, 400, 64, 3)
    df = spark.createDataFrame([(simhash._signed(c), simhash._signed(c), 0) for c in codes], "node long, code long, band int")
    edges = simhash.similar_edges(written(df, "t"), 64, 2, node_rows=node_rows)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_groups([simhash._signed(c) for c in codes], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {n: got.get(n, n) for n in want} == want


def test_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 700)] + [(3, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 3 for i in [7, *range(500, 700)])


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    out = [None, "", " ", "x", "x", "X"]
    for _ in range(25):
        t = [word() for _ in range(rng.randint(3, 400))]
        for _ in range(rng.randint(1, 4)):
            out.append(" ".join(t))
            t = list(t)
            t[rng.randrange(len(t))] = word()
    return out + ["hot copy of words"] * 60


def test_near_duplicates(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, "n", 5) for i, t in enumerate(ts)], "doc_id long, text string, node string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [brute_print(t, 3) for t in ts]
    root = brute_groups(range(len(ts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in range(len(ts))}


def test_null_ids_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (9, "a b c"), (9, "a b c"), (None, "other words here now")], "doc_id long, text string")
    got = sorted(map(repr, simhash.near_duplicates(df).select("doc_id", "component_id").collect()))
    assert got == sorted(map(repr, [r for r in spark.createDataFrame([(None, 9), (9, 9), (9, 9), (None, None)], "doc_id long, component_id long").collect()]))
    assert simhash.near_duplicates(df.where("doc_id > 99")).count() == 0


def shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b, at_least=0.8):
    """Exact Jaccard similarity; texts without words are alike."""
    return a == b or len(a & b) * 10 >= round(at_least * 10) * len(a | b)


def near_copies(rng, n, copies, edits):
    """Families of texts; each copy edits its original at up to ``edits`` places."""
    out = []
    for g in range(n):
        t = [f"{g}w{rng.randint(0, 10**6)}" for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(copies):
            v = list(t)
            for _ in range(rng.randint(0, max(1, int(edits * len(t))))):
                v[rng.randrange(len(v))] = "edit" + str(rng.random())
            out.append(" ".join(v))
    return out


def test_similar_documents(spark):
    rng = random.Random(6)
    texts = near_copies(rng, 60, 6, 0.03) + near_copies(rng, 60, 2, 0.03) + ["", None, "a b", "A b", "a c"]
    df = spark.createDataFrame([(i, t, "n", 5) for i, t in enumerate(texts)], "doc_id long, text string, node string, component_id int")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    sets = [shingles(t) for t in texts]
    want = brute_groups(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    # No document is in a group of others than the brute force has; nearly all links are found.
    assert all(want[c] == want[i] for i, c in got.items())
    assert sum(got[i] == c for i, c in want.items()) >= 0.97 * len(want)


def test_recall_right_above_the_threshold(spark):
    rng = random.Random(16)
    texts = near_copies(rng, 900, 2, 0.03)
    sets = [shingles(t) for t in texts]
    close = [i for i in range(0, len(texts), 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.85]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(close) > 40 and sum(got[i] == got[i + 1] for i in close) >= 0.9 * len(close)


def test_no_link_is_lost(spark):
    rng = random.Random(26)
    texts = near_copies(rng, 150, 2, 0.03) + near_copies(rng, 30, 8, 0.05)
    sets = [shingles(t) for t in texts]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_groups(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))


@pytest.mark.parametrize("together", [2, 4096])
def test_the_exact_join_loses_no_pair(spark, together):
    rng = random.Random(27)
    sets = [set()]
    for _ in range(12):
        base = rng.sample(range(400), rng.randint(1, 40))
        sets += [set(base[: len(base) - rng.randint(0, 3)]) | set(rng.sample(range(400), rng.randint(0, 3))) for _ in range(12)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    common = np.arange(0, 400, 3, dtype=np.uint64)
    rows = [(i, len(a), simhash.first_shingles(a, common, 800).tolist()) for i, a in enumerate(arrays)]
    nodes = written(spark.createDataFrame(rows, "node long, n long, firsts array<long>"), "t")
    roots = written(spark.createDataFrame([(i, i - i % 3) for i in range(0, len(sets), 2)], "node long, root long"), "t")
    root = {i: i if i % 2 else i - i % 3 for i in range(len(sets))}
    got = [tuple(r) for r in simhash.missed(nodes, roots, 0.8, together).collect()]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if root[a] != root[b] and sets[a] and alike(sets[a], sets[b])}
    assert want <= {(a, b) for a, _, b, _ in got} and len(want) > 50
    assert all(a < b and (ra, rb) == (root[a], root[b]) and ra != rb for a, ra, b, rb in got) and len(set(got)) == len(got)


def test_parities_never_rule_out_a_link():
    rng = random.Random(28)
    for _ in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.randint(1, 3000))]
        a, b = (np.array(sorted(set(base[: len(base) - rng.randint(0, len(base) // 5)]) | {rng.getrandbits(64)}), np.uint64) for _ in range(2))
        differ = int(np.bitwise_count(simhash.parities(a).view(np.uint64) ^ simhash.parities(b).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_local_candidates_span_all_candidates():
    rng = random.Random(3)
    codes, near, group = [], [], []
    for g in range(4):
        for _ in range(12):
            c, w = rng.getrandbits(32), rng.getrandbits(256)
            for _ in range(rng.randint(1, 12)):
                codes.append(c ^ sum(1 << rng.randrange(32) for _ in range(rng.randint(0, 2))) & (2**32 - 1))
                near.append(w ^ sum({1 << rng.randrange(256) for _ in range(rng.randint(0, 40))}))
                group.append(g)
    order = sorted(range(len(codes)), key=lambda i: (group[i], codes[i]))
    codes, near, group = ([x[i] for i in order] for x in (codes, near, group))
    wide = np.array([[w >> 64 * k & (2**64 - 1) for k in range(4)] for w in near], np.uint64)
    u, v = simhash.local_candidates(np.array(codes, np.uint64), np.array(group), wide, 2, 21, 53)
    candidate = lambda a, b: group[a] == group[b] and (codes[a] ^ codes[b]).bit_count() <= 2 and (near[a] ^ near[b]).bit_count() <= 53
    assert all(candidate(a, b) for a, b in zip(u.tolist(), v.tolist(), strict=True))
    links = {frozenset(x) for x in zip(u.tolist(), v.tolist(), strict=True)}
    assert brute_groups(range(len(codes)), lambda a, b: frozenset((a, b)) in links) == brute_groups(range(len(codes)), candidate)


def test_many_copies_of_one_code_are_linear():
    rng = np.random.default_rng(5)
    n, families = 60_000, 7
    base = rng.integers(0, 2**63, (families, 4)).astype(np.uint64)
    near = base[np.arange(n) % families] ^ (np.uint64(1) << rng.integers(0, 63, (n, 4)).astype(np.uint64))
    began = time.perf_counter()
    u, _ = simhash.local_candidates(np.zeros(n, np.uint64), np.zeros(n, np.int64), near, 2, 21, 53)
    assert len(u) == n - families and time.perf_counter() - began < 2


def test_similar_documents_null_ids_repeats_and_no_rows(spark):
    words = "some words of a text that is here more than once"
    df = spark.createDataFrame([(None, words), (9, words), (9, words), (None, "other words here now"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in simhash.similar_documents(df).collect())
    assert got == sorted(map(repr, [(None, 9), (9, 9), (9, 9), (None, None), (4, 4), (5, 4)]))
    assert simhash.similar_documents(df.where("doc_id > 99")).count() == 0


def test_beyond_the_broadcast_bound_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "SMALL_BYTES", 0)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    left = spark.createDataFrame([(i % 3, i) for i in range(60)] + [(None, 60)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k int, w string")
    joined = shared.spread_join(left, right, ["k"], 1, ["v"], "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.v, r.w) for r in joined.collect()) == [(i, {0: "a", 1: "b"}.get(i % 3) if i < 60 else None) for i in range(61)]
