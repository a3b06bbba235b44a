"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The test items are the indexed collection and every passage of every training
text is a query. A passage is a window of words; windows overlap by the longest
item of a class of items of like length, so an item that a text contains lies
whole in one of them, and a long item does not make the passages of short ones
long. A posting's
impact is the term's BM25 weight in the item divided by the item's own total, so
a score is the share of an item that a passage covers, and all items with a score
of ``threshold`` or more are retrieved.

For each batch a vectorised pass over the rare terms of the items first finds the
passages that can reach the threshold at all: the terms outside an item's
essential ones cover less than half of the threshold, so a passage has to reach
the other half on essential terms. Only such passages run block-max WAND, which
skips by the impact bounds of posting lists and of their blocks. Both steps are
exact: no item above the threshold is lost. A retrieved item counts as a leak
once its question and its answer both overlap the passage in runs of words.

Nulls and odd input: null or empty texts have no passage and no leak; items that
are null or without a word are not searched; items of fewer than ``MIN_ITEM_WORDS``
words leak where all their words follow one another, with a score of 1; repeated items each get their id, a null item id is reported
as null. Every row of the input gives one row, null ids and repeated rows
included. Empty tables are allowed. Other columns are not read. Texts are read
whole.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import filter_in_arrow, written

#: Parameters of BM25.
K1, B = 1.2, 0.75
#: Postings in a block of an index list.
BLOCK = 32
#: Share of an item's weight that a passage has to cover.
THRESHOLD = 0.6
#: Shares of the question's and of the answer's word runs that the passage has to hold.
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
#: Words in a run of the verification.
RUN = 3
#: Words of an item from which it is searched by BM25; shorter ones by their exact run of words.
MIN_ITEM_WORDS = 8
#: Items are indexed in blocks of at most this many characters; only such a block, and the words of all items with their counts, are ever on the driver.
INDEX_CHARS = 16_000_000
#: Postings that the words of some passages are expanded to at a time, if no single passage has more.
EXPANDED = 1 << 20
#: Words of a text that are looked at together, about.
PIECE = 1 << 14
#: Words of the longest item of a class, by which passages are cut; each class has items of up to CLASS times the words.
SHORT_CLASS, CLASS = 64, 8

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the answer is the last sentence or line, or the last quarter if there is but one."""
    parts = [p for p in (words_of(s) for s in re.split(r"(?<=[.!?])\s+|\n+", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    cut = len(only) - max(1, len(only) // 4)
    return only[:cut], only[cut:]


def runs(words: list) -> set[tuple]:
    n = min(RUN, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list, words: list) -> float:
    """Share of the part's word runs that are among the words; a part without words is covered."""
    need = runs(part)
    if not need:
        return 1.0
    n = len(next(iter(need)))
    have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(need & have) / len(need)


@dataclass
class Index:
    """Flat arrays, 12 bytes a posting and 4 a word, beside the ids and the vocabulary."""

    ids: list
    vocabulary: dict[str, int]
    #: Words of the items one after another, where an item's begin, and how many of them are its question's.
    said: array
    said_start: array
    asked: array
    #: Where a term's postings begin; items in order within a term, and their impacts.
    start: array
    items: array
    impacts: array
    #: Where a term's blocks begin; the largest impact of each block, and of each term.
    block_start: array
    block_max: array
    list_max: array
    #: Essential postings by term, and what an item needs on them.
    essential_start: np.ndarray
    essential_item: np.ndarray
    essential_impact: np.ndarray
    needed: np.ndarray
    longest: int
    #: By first word: the words of short items, and their places in ``ids``, which has them after the others.
    short: dict[str, list[tuple[list[str], int]]]
    #: Order of the items as given, by place in ``ids``.
    order: list[int]

    def postings(self, term: int) -> Iterator[tuple[int, float]]:
        """(item, impact) of a term."""
        for p in range(self.start[term], self.start[term + 1]):
            yield self.items[p], self.impacts[p]

    def part(self, item: int) -> tuple[list[int], list[int]]:
        """Terms of an item's question and of its answer."""
        a, b = self.said_start[item], self.said_start[item + 1]
        cut = a + self.asked[item]
        return self.said[a:cut].tolist(), self.said[cut:b].tolist()


def _flat(kind: str, values: np.ndarray) -> array:
    out = array(kind)
    out.frombytes(values.astype({"i": np.int32, "q": np.int64, "d": np.float64}[kind]).tobytes())
    return out


def _by_term(term: array, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of postings by term, and where each term's begin."""
    terms = np.frombuffer(term, np.int32) if len(term) else np.zeros(0, np.int32)
    return np.argsort(terms, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=n_terms)))).astype(np.int64)


@dataclass
class Statistics:
    """Number of the items that are searched by BM25, their words, and the items of each word."""

    n: int = 0
    words: int = 0
    df: Counter = field(default_factory=Counter)

    def add(self, words: list[str]) -> None:
        if len(words) >= MIN_ITEM_WORDS:
            self.n, self.words = self.n + 1, self.words + len(words)
            self.df.update(set(words))


def build(rows: list[tuple[object, str | None]], threshold: float = THRESHOLD, of_all: Statistics | None = None) -> Index:
    """Index of these items; ``of_all`` are the statistics of all items, where these are but a block of them."""
    if of_all is None:
        of_all = Statistics()
        for _, t in rows:
            of_all.add(words_of(t))
    ids, order, brief, vocabulary = [], [], [], {}
    said, said_start, asked = array("i"), array("q", [0]), array("i")
    for k, (i, text) in enumerate(rows):
        words = words_of(text)
        if 0 < len(words) < MIN_ITEM_WORDS:
            brief.append((i, words, k))
        elif words:
            ids.append(i)
            order.append(k)
            said.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
            said_start.append(len(said))
            asked.append(len(question_and_answer(text)[0]))
    n = len(ids)
    short: dict[str, list[tuple[list[str], int]]] = {}
    for k, (_, words, _) in enumerate(brief):
        short.setdefault(words[0], []).append((words, n + k))
    df = [of_all.df[w] for w in vocabulary]
    idf = [math.log(1 + (of_all.n - x + 0.5) / (x + 0.5)) for x in df]
    average = of_all.words / max(of_all.n, 1)
    term, item, impact = array("i"), array("i"), array("d")
    rare_term, rare_item, rare_impact = array("i"), array("i"), array("d")
    needed = np.zeros(n)
    for k in range(n):
        own = said[said_start[k] : said_start[k + 1]]
        norm = K1 * (1 - B + B * len(own) / average)
        weight = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(own).items()}
        total = sum(weight.values())
        ranked = sorted(weight, key=lambda t: (df[t], t))
        shares = [weight[t] / total for t in ranked]
        term.extend(ranked)
        item.extend([k] * len(ranked))
        impact.extend(shares)
        rest, some = 1.0, 0
        while some < len(ranked) and rest >= threshold / 2:
            rest -= shares[some]
            some += 1
        rare_term.extend(ranked[:some])
        rare_item.extend([k] * some)
        rare_impact.extend(shares[:some])
        # A little less than exact, for sums in another order.
        needed[k] = threshold - max(rest, 0) - 1e-9
    place, start = _by_term(term, len(vocabulary))
    impacts = np.array(impact)[place]
    sizes = np.diff(start)
    begins = np.flatnonzero((np.arange(len(place)) - np.repeat(start[:-1], sizes)) % BLOCK == 0)
    top = lambda at: np.maximum.reduceat(impacts, at) if len(at) else np.zeros(0)
    rare_place, rare_start = _by_term(rare_term, len(vocabulary))
    return Index(
        [*ids, *(i for i, _, _ in brief)],
        vocabulary,
        said,
        said_start,
        asked,
        _flat("q", start),
        _flat("i", np.array(item, np.int32)[place]),
        _flat("d", impacts),
        _flat("q", np.concatenate(([0], np.cumsum(-(-sizes // BLOCK))))),
        _flat("d", top(begins)),
        _flat("d", top(start[:-1])),
        rare_start,
        np.array(rare_item, np.int32)[rare_place],
        np.array(rare_impact)[rare_place],
        needed,
        int(np.diff(np.array(said_start)).max(initial=0)),
        short,
        [*order, *(k for _, _, k in brief)],
    )


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items that these distinct terms cover to ``threshold`` or more."""
    out, low = [], threshold - 1e-9
    items, impacts, start = index.items, index.impacts, index.start
    lists = [[items[start[t]], start[t], t] for t in terms]
    while lists:
        lists.sort()
        # The pivot is the first list at which the bounds of the lists so far reach the threshold.
        bound, pivot = 0.0, -1
        for i, (_, _, t) in enumerate(lists):
            bound += index.list_max[t]
            if bound >= low:
                pivot = i
                break
        if pivot < 0:
            break
        aimed = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == aimed:
            pivot += 1
        head = lists[: pivot + 1]
        # Bounds of the blocks that hold the pivot, and the last item for which they hold.
        tight, until = 0.0, math.inf
        for _, at, t in head:
            first, stop = start[t], start[t + 1]
            if (found := bisect_left(items, aimed, at, stop)) < stop:
                b = (found - first) // BLOCK
                tight += index.block_max[index.block_start[t] + b]
                until = min(until, items[min(first + (b + 1) * BLOCK, stop) - 1])
        if tight >= low:
            if head[0][0] == aimed:
                score = sum(impacts[x[1]] for x in head)
                if score >= low:
                    out.append((aimed, score))
                aim = aimed + 1
            else:
                aim = aimed
        else:
            # No item before the next block's start, or before the next list's item, can reach the threshold.
            following = lists[pivot + 1][0] if pivot + 1 < len(lists) else math.inf
            aim = max(aimed + 1, min(until + 1, following))
        for x in head:
            if x[0] < aim:
                stop = start[x[2] + 1]
                x[1] = bisect_left(items, aim, x[1], stop)
                x[0] = items[x[1]] if x[1] < stop else -1
        lists = [x for x in lists if x[0] >= 0]
    return out


def windows(n_words: int, longest: int) -> list[tuple[int, int]]:
    """Word ranges of twice the longest item, each starting one such length after the one before."""
    return [(s, min(s + 2 * longest, n_words)) for s in range(0, max(n_words - longest, 1), longest)] if n_words and longest else []


def all_leaks(indexes: list[Index], texts: list[str | None], threshold: float = THRESHOLD) -> list[list[tuple[object, float, float, float]]]:
    """For each text its leaks of long and of short items, by item id, in the order of the items."""
    docs = [words_of(t) for t in texts]
    out: list[list[tuple]] = [[] for _ in docs]
    for index in indexes:
        for all_found, found, words in zip(out, leaks(index, docs, threshold), docs, strict=True):
            found = [*found, *((item, 1.0, 1.0, 1.0) for item in (short_leaks(index, words) if index.short else ()))]
            all_found += [(index.order[item], index.ids[item], *x) for item, *x in found]
    return [[x[1:] for x in sorted(found, key=lambda x: x[0])] for found in out]


def short_leaks(index: Index, words: list[str]) -> set[int]:
    """The short items of which all words follow one another among these."""
    firsts = index.short
    return {item for at, word in enumerate(words) if word in firsts for run, item in firsts[word] if words[at : at + len(run)] == run}


def pieces(words: list[str], step: int) -> Iterator[list[str]]:
    """A text in parts that have the same windows as the whole, each window in one of them."""
    n, per = max((len(words) - step - 1) // step, 0) + 1, max(PIECE // step, 1)
    for a in range(0, n, per):
        yield words[a * step : (min(a + per, n) + 1) * step]


def leaks(index: Index, texts: list[str | None | list[str]], threshold: float = THRESHOLD) -> list[list[tuple[int, float, float, float]]]:
    """For each text, or list of its words, its leaks of items searched by BM25: (item, score, question overlap, answer overlap), an item once, by its best passage.

    Texts are looked at in pieces, as many at a time as have ``EXPANDED`` essential postings.
    """
    out: list[list] = [[] for _ in texts]
    if not index.longest:
        return out
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    get, count = index.vocabulary.get, np.diff(index.essential_start)
    some: list[tuple[int, np.ndarray]] = []
    size = 0
    for d, text in enumerate(texts):
        for piece in pieces(text if isinstance(text, list) else words_of(text), index.longest):
            terms = np.fromiter((get(w, -1) for w in piece), np.int64, len(piece))
            mine = int(count[terms[terms >= 0]].sum())
            if some and size + mine > EXPANDED:
                _search(index, some, threshold, best)
                some, size = [], 0
            some.append((d, terms))
            size += mine
    _search(index, some, threshold, best)
    for (d, item), found in sorted(best.items()):
        out[d].append((item, *found))
    return out


def _search(index: Index, docs: list[tuple[int, np.ndarray]], threshold: float, best: dict[tuple[int, int], tuple[float, float, float]]) -> None:
    """Puts the leaks of these pieces, given as terms (-1: of no item), into ``best`` by document and item."""
    step = index.longest
    lengths = np.array([len(t) for _, t in docs], np.int64)
    flat = np.concatenate([t for _, t in docs]) if docs else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    # Essential postings of each word occurrence.
    known = np.flatnonzero(flat >= 0)
    n = index.essential_start[flat[known] + 1] - index.essential_start[flat[known]]
    at = np.repeat(known, n)
    if not len(at):
        return
    posting = np.repeat(index.essential_start[flat[known]], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    doc = np.searchsorted(first, at, "right") - 1
    slot = (at - first[doc]) // step
    # A word in the s-th stretch of its text is in the windows s - 1 and s (the last one ends with the text).
    last = np.maximum((lengths[doc] - step - 1) // step, 0)
    span, width = int(last.max()) + 1, len(index.essential_item)
    keys = []
    for back in (0, 1):
        ok = (slot - back >= 0) & (slot - back <= last)
        keys.append((doc[ok] * span + slot[ok] - back) * width + posting[ok])
    window, posting = np.divmod(np.unique(np.concatenate(keys)), width)
    cover = window * len(index.ids) + index.essential_item[posting]
    places, inverse = np.unique(cover, return_inverse=True)
    mass = np.bincount(inverse, index.essential_impact[posting])
    hopeful = np.unique(places[mass >= index.needed[places % len(index.ids)]] // len(index.ids))
    for place in hopeful.tolist():
        k, s = divmod(place, span)
        d, terms = docs[k]
        passage = terms[s * step : s * step + 2 * step].tolist()
        for item, score in block_max_wand(index, sorted({t for t in passage if t >= 0}), threshold):
            question, answer = index.part(item)
            q, a = overlap(question, passage), overlap(answer, passage)
            if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (score, q, a))


def item_blocks(items: DataFrame, item_id: str, item_text: str) -> list[list[tuple]]:
    """The items in blocks of bounded size, brought to the driver one by one as they are asked for."""
    text = F.coalesce(F.col(item_text), F.lit(""))
    size = items.agg(F.sum(F.length(text)).alias("chars")).first()["chars"] or 0
    blocks = -(-size // INDEX_CHARS) or 1
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r[0], r[1]) for r in part.select(item_id, item_text).orderBy(item_id, item_text).collect()]


def length_class(n_words: int) -> int:
    """Items of a class differ in length by a factor of at most ``CLASS``; the first class has those of up to ``SHORT_CLASS`` words."""
    k, top = 0, SHORT_CLASS
    while n_words > top:
        k, top = k + 1, top * CLASS
    return k


def indexes_of(rows: list[tuple[object, str | None]], threshold: float = THRESHOLD, of_all: Statistics | None = None) -> list[Index]:
    """An index for each class of lengths, with common statistics and places in the order of ``rows``."""
    if of_all is None:
        of_all = Statistics()
        for _, text in rows:
            of_all.add(words_of(text))
    classes: dict[int, list[int]] = {}
    for k, (_, text) in enumerate(rows):
        classes.setdefault(length_class(len(words_of(text))), []).append(k)
    out = []
    for _, places in sorted(classes.items()):
        index = build([rows[k] for k in places], threshold, of_all)
        index.order = [places[k] for k in index.order]
        out.append(index)
    return out


def built(items: DataFrame, threshold: float, item_id: str, item_text: str) -> Iterator[tuple[list[Index], bool]]:
    """The indexes of each block of items, and whether another follows; more than one block share the statistics of all items, taken first."""
    blocks = item_blocks(items, item_id, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        yield indexes_of(first, threshold), False
        return
    of_all, n = Statistics(), 0
    for rows in itertools.chain([first, second], blocks):
        n += 1
        for _, text in rows:
            of_all.add(words_of(text))
    del first, second
    for k, rows in enumerate(item_blocks(items, item_id, item_text)):
        yield indexes_of(rows, threshold, of_all), k + 1 < n


def find_leaks(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, leaks) for each row of ``df``: an array of (item, score, question_overlap, answer_overlap).

    More than a block of items is searched block by block, with the statistics of all
    items, and what a block found is written before the next one is brought to the
    driver; the blocks' leaks of a row are put together.
    """
    id_type, key_type = df.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    hit = f"array<struct<item: {key_type}, score: double, question_overlap: double, answer_overlap: double>>"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast(hit).alias("leaks"))
    for indexes, more in built(items, threshold, item_id, item_text):
        rows = rows.mapInArrow(_searcher(indexes, threshold), f"id {id_type}, text string, leaks {hit}")
        rows = written(rows, "block-leaks") if more else rows
    return rows.select(F.col("id").alias(id_col), "leaks")


def _searcher(indexes: list[Index], threshold: float, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                found = all_leaks(indexes, b.column(1).to_pylist(), threshold)
                kind = b.schema.field(2).type
                so_far = b.column(2).to_pylist()
                named = [old + [dict(zip(("item", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in new] for old, new in zip(so_far, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named, kind)], ["id", "text", "leaks"])

    return run


def drop_leaking(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` without a leak, with all their columns."""
    at = df.columns.index(text_col)
    for indexes, more in built(items, threshold, item_id, item_text):
        keep = lambda b, indexes=indexes: pa.array([not x for x in all_leaks(indexes, b.column(at).to_pylist(), threshold)], pa.bool_())
        df = filter_in_arrow(df, keep, 256)
        df = written(df, "block-kept") if more else df
    return df
