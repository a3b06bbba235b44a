"""Line dedup against a plain Python template tree, on whole strings; only the sketches use the same hash function."""

import random
import re
from collections import Counter, defaultdict

import xxhash

from reviewloom.llm import line_dedup as ld

BLANKS = " \t\r\x0b\x0c"


def xx(seed, *values):
    """XXH64 of longs and strings, each with the hash before it as the seed; signed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed % (1 << 64))
    return seed - (1 << 64) if seed >> 63 else seed


def brute(texts):
    """Kept text of each text."""

    def tokens(line):
        return tuple(ld.FIELD if re.search("[0-9]", t) else t for t in re.split(f"[{BLANKS}]+", line.strip(BLANKS)))

    def form(line):
        t = tokens(line)
        if len(t) >= ld.MIN_TOKENS:
            return t
        return line.strip(BLANKS) if any(c.isalpha() for c in line) else None

    holders, places, sketches = defaultdict(set), {}, {}
    seeds = [xx(42, f"origin {j}") for j in range(ld.BANDS)]
    for t in {x for x in texts if x is not None}:
        said = [x for x in t.split("\n") if form(x) is not None]
        for x in said:
            holders[form(x)].add(t)
            places[form(x)] = tokens(x)
        openings = {xx(42, " ".join(tokens(x)[: ld.OPENING])) for x in said}
        if openings:
            picks = [min(o ^ s for o in openings) for s in seeds]
            sketches[t] = [xx(42, picks[j], picks[(j + 1) % ld.BANDS]) for j in range(ld.BANDS)]

    def recurs(held, least):
        shared = sum(max(Counter(sketches[t][j] for t in held).values()) - 1 for j in range(ld.BANDS))
        return len(held) >= least and shared <= ld.BANDS * (len(held) - 1) * (ld.ONE_ORIGIN - 1 / len(held))

    gone = {f for f, held in holders.items() if len(held) > 1 and recurs(held, 2 if len(places[f]) >= ld.LONG_TOKENS else 3)}
    nodes = defaultdict(list)
    for f, t in places.items():
        if len(t) >= ld.MIN_TOKENS:
            nodes[len(t), t[: ld.DEPTH]].append(f)
    todo = [v for v in nodes.values() if len(v) >= 3]
    while todo:
        forms = todo.pop()
        columns = [Counter(c) for c in zip(*forms, strict=True)]
        top = [max((n, t.encode(), t) for t, n in c.items()) for c in columns]
        shape = [t if 2 * n >= len(forms) else None for n, _, t in top]
        mine = [f for f in forms if sum(a == b for a, b in zip(f, shape, strict=True)) >= ld.AGREE * len(f)]
        if mine and recurs(set().union(*(holders[f] for f in mine)), 3):
            gone.update(mine)
        parts = defaultdict(list)
        for f in set(forms) - set(mine):
            parts[f[min((len(c), i) for i, c in enumerate(columns) if len(c) > 1)[1]]].append(f)
        todo += [v for v in parts.values() if len(v) >= 3]
    return [None if t is None else "\n".join(x for x in t.split("\n") if form(x) not in gone) for t in texts]


def make_texts(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    line = lambda n=None: " ".join(word() for _ in range(n or rng.randint(1, 14)))
    notice = "Posted on {} by the team {} in the news of today"
    passage, block = line(60), [line(9), line(7), line(8)]
    out = [None, "", "\n\n", "solo line of five tokens"]
    for i in range(60):
        parts = [line() for _ in range(rng.randint(1, 9))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        if i % 5 == 0:
            parts.insert(rng.randint(0, len(parts)), notice.format(rng.randint(1, 99), word()))
        if i % 7 == 0:
            at = rng.randint(0, len(parts))
            parts[at:at] = block
        text = "\n".join(parts)
        out += [text] * rng.choice([1, 1, 1, 6])
        if i % 10 == 3:  # near copies of one origin
            for _ in range(8):
                copy = [p.split(" ") for p in parts]
                k = rng.randrange(len(copy))
                copy[k][-1] = word()
                out.append("\n".join(" ".join(p) for p in copy))
    return out, passage, block


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, form int")
    return {r.row.doc_id: r for r in ld.drop_recurring_lines(df).collect()}


def test_matches_brute_force(spark):
    texts, passage, block = make_texts(random.Random(11))
    got = run(spark, texts)
    want = brute(texts)
    assert [got[i].text for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        lines = 0 if t is None else len(t.split("\n"))
        assert got[i].n_lines == lines and got[i].row.key == "k"
    assert not any(passage in (t or "") for t in want) and not any(b in (t or "") for t in want for b in block)
    # Templates with variable fields go, lines of copies and near copies stay.
    assert not any("by the team" in (t or "") for t in want)
    alone = [t for t in texts if t and t not in (passage,) and "Posted" not in t and passage not in t and not any(b in t for b in block)]
    assert sum(t in want for t in alone) > 0.95 * len(alone)


def test_copies_alone_lose_nothing(spark):
    text = "first line with some words here\nsecond line has more words in it"
    texts = [text] * 9 + [text + "\nx" * k for k in range(1, 5)] + [None, None]
    assert [r.text for _, r in sorted(run(spark, texts).items())] == texts


def test_null_ids_repeats_and_no_rows(spark):
    rows = [(None, f"head{c} of doc {c} is here\nthis line is in all of them") for c in "abcdefg"] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ld.drop_recurring_lines(df).collect()
    assert len(out) == 14 and all("in all of them" not in r.text and r.n_dropped == 1 for r in out)
    assert ld.drop_recurring_lines(df.limit(0)).collect() == []


def unrelated(rng, own, shared, docs=40):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    return ["\n".join([" ".join(word() for _ in range(8)) for _ in range(own)] + shared) for _ in range(docs)]


def test_shared_lines_of_unrelated_documents_go(spark):
    rng = random.Random(5)
    block = unrelated(rng, 20, [], 1)[0].split("\n")
    line = "this one line is shared by all of them"
    # A block of several lines, a line with a blank one, and long documents.
    for own, shared in ((2, block[:2]), (2, block[:6]), (4, block[:4]), (1, block[:2]), (5, block[:10]), (10, block), (3, ["", line]), (4, ["", line, ""]), (400, [line, "and the other things"])):
        texts = unrelated(rng, own, shared)
        got = run(spark, texts)
        assert all(not set(x for x in shared if len(x.split()) >= ld.MIN_TOKENS) & set(r.text.split("\n")) for r in got.values())
        assert all(r.text.split("\n")[:own] == texts[i].split("\n")[:own] for i, r in got.items())


def test_near_copies_and_one_line_documents_stay(spark):
    rng = random.Random(6)
    base = unrelated(rng, 20, [], 1)[0].split("\n")
    near = []
    for i in range(30):
        copy = list(base)
        copy[i % 20] = unrelated(rng, 1, [], 1)[0]
        near.append("\n".join([*copy, ""]))
    alone = [f"a page of the number {i} with nothing else" for i in range(20)]
    got = run(spark, near + alone)
    assert [got[i].text for i in range(len(got))] == near + alone


def test_several_templates_of_a_leaf_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 8)))
    templates = ("Posted by admin in the topic {} for all readers", "Posted by admin at the desk of {} last night", "Posted by admin and seen from {} on this day")
    lines = [t.format(word()) for t, n in zip(templates, (60, 40, 40), strict=True) for _ in range(n)]
    others = ["Posted by admin " + " ".join(word() for _ in range(7)) for _ in range(150)]
    texts = ["\n".join(unrelated(rng, 4, [x], 1)) for x in lines + others]
    got = run(spark, texts)
    assert [got[i].n_dropped for i in range(len(texts))] == [1] * len(lines) + [0] * len(others)
    assert all(x not in got[i].text for i, x in enumerate(lines))


def test_short_lines_and_long_ones_of_two_documents_go(spark):
    rng = random.Random(9)
    passage = unrelated(rng, 1, [], 1)[0] + " and " + unrelated(rng, 1, [], 1)[0]
    texts = [t + ("\nAll rights reserved.\n  Home \n***\nPage 3" if i < 5 else "\nPage 4") + (f"\n{passage}" if i > 7 else "") for i, t in enumerate(unrelated(rng, 4, [], 10))]
    got = run(spark, texts)
    own = ["\n".join(t.split("\n")[:4]) for t in texts]
    assert [got[i].text for i in range(10)] == [own[i] + ("\n***" if i < 5 else "") for i in range(10)]
    # Too few texts for a short line; two related ones for a long one; a number alone is no line to drop.
    some = unrelated(rng, 4, [], 6)
    texts = [some[0] + "\nContact us", some[1] + "\nContact us", some[2] + f"\n{passage}", some[2] + f"\n{passage}\nend", some[3] + "\n17", some[4] + "\n17", some[5] + "\n17"]
    got = run(spark, texts)
    assert [got[i].text for i in range(len(texts))] == texts


def test_small_blocks_of_many_documents_go(spark):
    rng = random.Random(12)
    for shared, own in ((6, 2), (4, 4), (2, 1), (3, 2), (8, 4)):
        block = unrelated(rng, shared, [], 1)[0].split("\n")
        texts = unrelated(rng, own, block, 200)
        assert all(r.text.split("\n") == texts[i].split("\n")[:own] for i, r in run(spark, texts).items()), (shared, own)


def test_very_long_texts_and_ids_of_any_name(spark):
    rng = random.Random(13)
    own = [f"the {w} of line {w}{w} is all its own" for w in ("".join(rng.choices("abcdefgh", k=9)) for _ in range(30_000))]
    often = "this one line is shared by all of the three"
    texts = ["\n".join(x for o in own[k::3] for x in (o, often)) for k in range(3)] + ["w " * 400_000 + often]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "n_lines long, text string, row string")
    got = {r.row.n_lines: r for r in ld.drop_recurring_lines(df, "n_lines").collect()}
    assert [got[i].n_dropped for i in range(4)] == [10_000, 10_000, 10_000, 0] or [got[i].n_dropped for i in range(4)] == [20_000, 20_000, 20_000, 0]
    assert got[3].text == texts[3] and got[0].n_lines == 20_000 and often not in got[0].text.split("\n")
