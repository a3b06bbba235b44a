"""LM scoring by a probabilistic suffix tree.

A state is a context: the last words before a symbol, none to ``MAX_DEPTH`` of
them. The tree grows from its root, the empty context. A context one word longer
than a state is tested if it occurs ``MIN_COUNT`` times in the training texts and has ``MIN_SHARE`` of all places there, and
retained if what follows it differs enough from what follows the state: if, over
its occurrences, each left out of the counts in turn, its own distribution
predicts the next symbol better than the state's by ``GAIN`` on average (log10).
A state's distribution is smoothed with that of its own suffix, as ``PRIOR`` further
occurrences, and the root's by a tenth of an occurrence for each symbol. A text is
scored symbol by symbol, each by the state of its longest retained suffix.

The model grows with the corpus, so no task ever has it whole. Texts are cut into
chunks of words, which stay where they were written. A chunk needs, of all
statistics, only those that its own words, pairs and contexts name: it asks for
sums over all chunks by key, keys are dealt to buckets by their hash, each chunk's
part of a sum being one entry, and the sums go back to the chunks that asked.
What all occurrences of a word or pair in one chunk can tell isn't asked for.
``_chunk_work`` is what a chunk does, with its questions as ``yield``; it is run anew for
each round, with the answers so far, until it returns its texts' scores. Chunks and answers are
bucketed by chunk, so texts are never shuffled. Keys are 64-bit hashes.

Nulls and odd input: a null text is an empty one, which has only its end to be
scored. A null id is not held out. Repeated rows are rows like any other, in
training too. Texts of any length are read whole; one longer than a chunk goes on in the
next with the words before as context. Without training texts everything has
probability one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import beside, tables_made, written
from reviewloom.sources.scratch import new_path

#: Words of the longest context.
MAX_DEPTH = 2
#: Occurrences in training, and share of all its places, from which a context is tested. The share bounds the states of a depth at any size.
MIN_COUNT, MIN_SHARE = 32, 1e-6
#: Mean gain, in log10 of the probability of the next symbol, from which a context is retained.
GAIN = 0.01
#: Occurrences that the suffix's distribution counts for.
PRIOR = 128.0
#: Fixed value: occurrences that are added for each symbol, an unknown one too, at the root.
ADDED = 0.1
#: Tokens of a chunk, and keys that a bucket has at most, on average.
CHUNK, BUCKET_KEYS = 3 << 18, 1 << 20
#: Fixed value: one row in so many, by the checksum of its id, is held out.
HELD_OUT = 10
#: The symbol after the last word; no word is empty.
_END = b""
#: Bytes of a text that are taken apart at a time, and what separates words.
_SLICE, _BLANK = 1 << 22, re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers of :func:`_mix`.
_M1, _M2, _M3, _M4 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Settings:
    """Parameters of the model and of how it is worked out."""

    depth: int = MAX_DEPTH
    min_count: int = MIN_COUNT
    min_share: float = MIN_SHARE
    gain: float = GAIN
    prior: float = PRIOR
    chunk: int = CHUNK
    bucket_keys: int = BUCKET_KEYS


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M1 + b * _M2
    x ^= x >> np.uint64(32)
    x *= _M3
    x ^= x >> np.uint64(29)
    x *= _M4
    return x ^ (x >> np.uint64(32))


def _packed(a: np.ndarray) -> bytes:
    """An array byte by byte of its elements, so that what its elements have in common takes little room."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The lower-cased words, a bounded list at a time; bytes.lower and bytes.split know A-Z and the six blanks only."""
    data, start = (text or "").encode(errors="surrogatepass"), 0
    while start < len(data):
        cut = _BLANK.search(data, start + _SLICE)
        end = cut.start() if cut else len(data)
        yield data[start:end].lower().split()
        start = end


@dataclass
class Chunk:
    """Some texts, or parts of them, in a row: their tokens as numbers of the chunk's vocabulary."""

    hashes: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    #: Tokens before the first one that is the chunk's own.
    head: int

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)[:-1]])


class _Cutter:
    """Cuts the texts of a partition into chunks."""

    def __init__(self, settings: Settings):
        self.settings, self.made = settings, 0
        self._open([])

    def _open(self, head: list[bytes]) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.codes, self.ids, self.rows, self.lengths, self.held = [], [], [], [], []
        self.head, self.size = len(head), 0
        self._put(head)

    def _put(self, words: list[bytes]) -> None:
        self.codes.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self) -> dict | None:
        """What goes into the table of chunks."""
        if not self.rows:
            return None
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary], np.uint64)
        place = TaskContext.get().partitionId()
        self.made += 1
        return {
            "p": (place << 31) + self.made,
            "ids": self.ids,
            "rows": self.rows,
            "lengths": self.lengths,
            "held": self.held,
            "head": self.head,
            "n": self.size - self.head,
            "hashes": _packed(hashes),
            "tokens": _packed(np.concatenate(self.codes)),
        }

    def add(self, row_id, row: int, text: str | None, held: bool) -> Iterator[dict]:
        size, last = 0, []
        lists = _words(text)
        following = next(lists, [])
        while True:
            words, following = following, next(lists, None)
            if following is None:
                words = [*words, _END]
            while words:
                room = max(self.settings.chunk - self.size, 1)
                now, words = words[:room], words[room:]
                self._put(now)
                size += len(now)
                last = [*last, *now[-self.settings.depth :]][-self.settings.depth :]
                if words:
                    # The text goes on in another chunk, after its last words as context.
                    self._piece(row_id, row, size, held)
                    yield self.close()
                    self._open(last)
                    size = len(last)
            if following is None:
                break
        self._piece(row_id, row, size, held)
        if self.size >= self.settings.chunk:
            yield self.close()
            self._open([])

    def _piece(self, row_id, row: int, length: int, held: bool) -> None:
        self.ids.append(row_id)
        self.rows.append(row)
        self.lengths.append(length)
        self.held.append(held)


#: A question of a chunk: sorted keys and its own part of each one's sum. Of a key with the last bit the sum's sign is wanted, else the sum.
Asked = list[tuple[np.ndarray, np.ndarray]]
_SIGN = np.uint64(1)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, the sum of each one's weights, and each key's place among them."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ordered[fresh], np.bincount(place, weights, int(fresh.sum())), place


def _chunk_work(chunk: Chunk, settings: Settings, total: int, known: int) -> Generator[Asked, list[np.ndarray], list[np.ndarray]]:
    """Asks for sums over all chunks by key, round after round, and returns (n_tokens, n_known, base, score) of each piece.

    ``total`` and ``known``, the training tokens and the different ones, are needed from the second round on.
    """
    size, starts = len(chunk.tokens), chunk.starts()
    own = np.ones(size, bool)
    own[: chunk.head] = False
    learns = (np.repeat(~chunk.held, chunk.lengths) & own).astype(float)
    behind = (np.arange(size) - np.repeat(starts, chunk.lengths)).astype(np.int32)
    # Words of one hash are one word.
    hashes, _, word = _summed(chunk.hashes & ~_SIGN, np.zeros(len(chunk.hashes)))
    words = word[chunk.tokens]
    local = np.bincount(words, learns, len(hashes))
    (counts,) = yield [(hashes, local)]

    token = hashes[words]
    seen, mine = counts[words], local[words]
    root = (seen + ADDED) / (total + ADDED * (known + 1))
    least = max(settings.min_count, settings.min_share * total)
    chances, retained = root.copy(), np.ones(size, bool)
    # Of the depth before: occurrences of (context, symbol) in all chunks and in this one, where the context is frequent enough.
    found, context, tested = seen, np.zeros(size, np.uint64), None
    for depth in range(1, settings.depth + 2):
        asks: Asked = []
        if tested is not None:
            at, times, pairs, state, kept = tested
            # Every occurrence is left out of the counts in its turn.
            alone = (pairs - 1 + settings.prior * chances[at]) / (times - 1 + settings.prior)
            learning = learns[at] > 0
            gains = np.zeros(len(at))
            gains[learning] = np.log10(alone[learning] / chances[at][learning]) - settings.gain
            # What is longer than no state is none.
            keys, sums, place = _summed(state[kept] | _SIGN, gains[kept])
            asks.append((keys, sums.astype(np.float32).astype(float)))
        if depth <= settings.depth:
            # The context of a token is that of the token before, extended by it; so its count is that of the pair before.
            longer, there = np.zeros(size, np.uint64), np.zeros(size)
            longer[depth:] = _mix(context[depth:], token[: size - depth])
            there[1:] = found[:-1]
            deeper = np.flatnonzero((behind >= depth) & (there >= least))
            context = longer
            pair_keys, pair_sums, pair_place = _summed(_mix(context[deeper], token[deeper] ^ np.uint64(depth)) & ~_SIGN, learns[deeper])
            # A symbol that training has after the shorter context in this chunk only, or nowhere, needs no question.
            elsewhere = np.zeros(len(pair_keys), bool)
            elsewhere[pair_place] = found[deeper] > mine[deeper]
            asks.append((pair_keys[elsewhere], pair_sums[elsewhere]))
        answers = yield asks
        if tested is not None:
            good = kept.copy()
            good[kept] = answers[0][place] >= 0
            retained = np.zeros(size, bool)
            retained[at[good]] = True
            chances[at[good]] = ((pairs + settings.prior * chances[at]) / (times + settings.prior))[good]
        if depth <= settings.depth:
            everywhere = pair_sums.copy()
            everywhere[elsewhere] = answers[-1]
            found, mine = np.zeros(size), np.zeros(size)
            found[deeper], mine[deeper] = everywhere[pair_place], pair_sums[pair_place]
            tested = (deeper, there[deeper], found[deeper], _mix(context[deeper], np.full(len(deeper), depth, np.uint64)), None)
        if tested is not None:
            tested = (*tested[:4], retained[tested[0]])

    def each(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(own, values, 0), starts)

    return [each(np.ones(size)), each(seen > 0), each(np.log10(root)), each(np.log10(chances))]


def _read(r: dict) -> Chunk:
    return Chunk(_unpacked(r["hashes"], np.uint64), _unpacked(r["tokens"], np.int32), np.array(r["lengths"], np.int64), np.array(r["held"], bool), r["head"])


def _joined(asks: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all questions of a round in order, their weights, and the order."""
    keys, weights = np.concatenate([k for k, _ in asks]), np.concatenate([w for _, w in asks])
    order = np.argsort(keys, kind="stable")
    return keys[order], weights[order], order


def _replayed(r: dict, settings: Settings, total: int, known: int, rounds: int) -> tuple[Asked | None, list[np.ndarray] | None]:
    """What a chunk asks after ``rounds`` rounds, or its result if that was all."""
    work = _chunk_work(_read(r), settings, total, known)
    asks = next(work)
    for k in range(rounds):
        _, _, order = _joined(asks)
        answer = np.empty(len(order))
        parts = sorted(r[f"answer{k}"] or [], key=lambda x: x["bucket"])
        if len(order):
            answer[order] = np.concatenate([_unpacked(x["sums"], np.float64) for x in parts])
        try:
            asks = work.send(np.split(answer, np.cumsum([len(x) for x, _ in asks])[:-1]))
        except StopIteration as done:
            return None, done.value
    return asks, None


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _added_up(group: pa.Table) -> pa.Table:
    """The answers to one bucket's questions, and, as chunk -1, how many keys have a sum above zero."""
    asked = [_unpacked(k.as_py(), np.uint64).cumsum(dtype=np.uint64) for k in group["keys"]]
    weights = [_unpacked(w.as_py(), np.float64) for w in group["weights"]]
    keys, sums, place = _summed(np.concatenate(asked), np.concatenate(weights))
    sums = np.where(keys & _SIGN, np.sign(sums), sums)
    ends = np.cumsum([len(k) for k in asked])
    answers = [_packed(sums[p]) for p in np.split(place, ends[:-1])]
    chunks = [*group["p"].to_pylist(), -1]
    bucket = group["bucket"][0].as_py()
    return pa.table({"p": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "sums": pa.array([*answers, _packed(np.array([(sums > 0).sum()], float))], pa.binary())})


def _bucketed(df: DataFrame, parts: int, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder that is bucketed by chunk, and the table's name."""
    spark, name = df.sparkSession, f"reviewloom_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, "p").option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name), name


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008 - frozen
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``n_tokens``: words and the end; ``n_known``: those that training has seen; ``train_tokens``: all of training;
    ``base_score``: log10 probability by the root alone; ``score``: by the tree.
    """
    spark = df.sparkSession
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`")).alias("held"))
    schema = f"p long, ids array<{kind}>, rows array<long>, lengths array<int>, held array<boolean>, head int, n long, hashes binary, tokens binary"
    ids_type = pa.list_(_arrow_type(df, id_col))

    def batch(r: dict) -> pa.RecordBatch:
        kinds = {"ids": ids_type, "rows": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "held": pa.list_(pa.bool_()), "head": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k)) for k, v in r.items()], list(r))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(settings)
        for b in batches:
            ids, places, texts, held = (b.column(c) for c in ("id", "row", "text", "held"))
            for i in range(b.num_rows):
                for made in cutter.add(ids[i].as_py(), places[i].as_py(), texts[i].as_py(), held[i].as_py()):
                    yield batch(made)
        if (made := cutter.close()) is not None:
            yield batch(made)

    names: list[str] = []
    try:
        with tables_made(spark) as drop_but:
            parts = min(max(2 * rows.rdd.getNumPartitions(), 1), 1 << 15)
            chunks, name = _bucketed(rows.mapInArrow(cut, schema), parts, "chunks")
            names.append(name)
            # The tokens of training are those of the pieces, less the context of the first.
            trained = F.aggregate(F.arrays_zip("lengths", "held"), F.lit(0).cast("long"), lambda n, x: n + F.when(x["held"], 0).otherwise(x["lengths"])) - F.when(F.get("held", F.lit(0)), 0).otherwise(F.col("head"))
            facts = chunks.agg(F.sum("n").alias("all"), F.sum(trained).alias("trained")).first()
            total, known = facts["trained"] or 0, 0
            buckets = -(-(facts["all"] or 0) // settings.bucket_keys) or 1
            state = chunks
            for k in range(settings.depth + 2):
                asked = state.mapInArrow(_asking(settings, total, known, k, buckets), "p long, bucket int, keys binary, weights binary")
                sums = asked.groupBy("bucket").applyInArrow(_added_up, "p long, bucket int, sums binary")
                if k == 0:
                    sums = written(sums, "sums")
                    known = sum(int(_unpacked(r["sums"], np.float64)[0]) for r in sums.where("p = -1").select("sums").toLocalIterator())
                answers = sums.where("p >= 0").groupBy("p").agg(F.collect_list(F.struct("bucket", "sums")).alias(f"answer{k}"))
                answers, name = _bucketed(answers, parts, "answers")
                names.append(name)
                state = state.join(answers.hint("shuffle_hash"), "p", "left")
            pieces = state.mapInArrow(_scoring(settings, total, known, batch), f"ids array<{kind}>, rows array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>")
            each = pieces.select(F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("ids").alias("id"), "held", "n_tokens", "n_known", "base", "score")))
            # A text that was cut has several pieces.
            whole = each.groupBy("row").agg(F.first("id").alias("id"), F.first("held").alias("held"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
            out = written(whole, "scores")
            drop_but(("scores",))
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    name = lambda c: beside(id_col, c)
    return out.select(
        F.col("id").alias(id_col),
        F.col("held").alias(name("held_out")),
        F.col("n_tokens").alias(name("n_tokens")),
        F.col("n_known").alias(name("n_known")),
        F.lit(total).cast("long").alias(name("train_tokens")),
        F.col("base").alias(name("base_score")),
        F.col("score").alias(name("score")),
    )


def _arrow_type(df: DataFrame, id_col: str) -> pa.DataType:
    return df.select(F.col(f"`{id_col}`")).limit(0).toArrow().schema[0].type


def _asking(settings: Settings, total: int, known: int, rounds: int, buckets: int):
    """Each chunk's questions of the next round, a row for each bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            asks, _ = _replayed(r, settings, total, known, rounds)
            keys, weights, _ = _joined(asks)
            if not len(keys):
                continue
            # Buckets are ranges of the hash, so each has a run of the ordered keys.
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            cells = [(_packed(np.diff(k, prepend=np.uint64(0))), _packed(w)) for k, w in zip(np.split(keys, starts[1:]), np.split(weights, starts[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["p"]] * len(cells), pa.int64()), pa.array(bucket[starts].astype(np.int32)), pa.array([k for k, _ in cells], pa.binary()), pa.array([w for _, w in cells], pa.binary())],
                ["p", "bucket", "keys", "weights"],
            )

    return ask


def _scoring(settings: Settings, total: int, known: int, batch):
    """Each chunk's pieces with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            _, (n, seen, base, scores) = _replayed(r, settings, total, known, settings.depth + 2)
            yield batch({"ids": r["ids"], "rows": r["rows"], "held": r["held"], "n_tokens": [int(x) for x in n], "n_known": [int(x) for x in seen], "base": list(map(float, base)), "score": list(map(float, scores))})

    return run
