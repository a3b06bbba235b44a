"""Cost-balanced packing of tokenised documents.

Documents are packed in blocks: a task gathers documents until it has
``BLOCK_TOKENS`` tokens, or its input ends, and packs that block by itself, so
there is no shuffle and memory is bounded. In a block, whole sequences are cut
from the front of long documents; the rests, in descending length, each go to the
sequence of lowest cost that has room. A sequence's cost is linear plus quadratic
in its pieces, as attention runs within a piece. The block opens just as many
sequences as its tokens need; a rest that no sequence has room for is cut over
those with the most room. The one sequence of a block that stays short is
halved into lengths that are powers of two, so that it needs no padding.

Nulls and odd input: a null text counts as empty; an empty text is its closing id
alone. Null ids and repeated rows are packed like any other row. An empty table
gives an empty result. Other columns are not read. Texts of any length are
tokenised whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Tokens in a full sequence.
LENGTH = 2048
#: The id that closes a document.
END_ID = 1
#: Tokens that a task packs together.
BLOCK_TOKENS = 4_000_000
#: Different words whose ids a task remembers, besides as many from before those.
MEMO_WORDS = 200_000
#: Punctuation that makes a piece of its own behind a letter.
CLOSING = ".,!#$%&*"
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1 / LENGTH


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of white-space separated words by the word BPE of 49k, as little-endian 32-bit bytes.

    The tokenizer's pieces never span white space, so a text's ids are its words'
    ids in order; a letter before closing punctuation always ends a piece.
    When ``MEMO_WORDS`` words have come they are set aside, and those that occur
    again are taken back, so only words that have not occurred for long are forgotten.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.letters = byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def encoded(self, text: str) -> bytes:
        return b"".join([self.four[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.made(word)
        if len(self) >= MEMO_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def made(self, word: str) -> bytes:
        rest = word.rstrip(CLOSING)
        if len(rest) < len(word) and rest[-1:].lower().isalpha():
            ids = self[rest] + self[word[len(rest) :]]
        elif word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word):
            # One run of letters that are composed already: only case and the byte alphabet are left to apply, and that not to ASCII.
            low = word.lower()
            mapped = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
            ids = b"".join([self.four[t.id] for t in self.model.tokenize(mapped)])
        else:
            ids = self.encoded(word)
        return ids

    def of(self, text: str | None) -> bytes:
        """Ids of a whole text and the closing id."""
        end = END_ID.to_bytes(4, "little")
        if not text:
            return end
        if "<|" in text:  # may hold a control token, which may span words
            return self.encoded(text) + end
        # Only blanks and line ends divide words here; the tokenizer handles other white space.
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ") if w]) + end


class TextIds:
    """Ids by any tokenizers file: whole texts go through the tokenizer itself."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def of(self, text: str | None) -> bytes:
        ids = self.tokenizer.encode(text or "", add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in [*ids, END_ID])


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Tokenizer:
    """A tokenizers file, read once in a Python worker instead of in each of its tasks."""
    return Tokenizer.from_file(path)


def assigned(rests: list[tuple[int, int]], lengths: list[int], bins: int, size: int) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """(pieces (document, start, length) of each sequence, tokens of each) for rests (length, document), longest first.

    A rest goes to the sequence of lowest cost that has room, the emptier and then
    the first one at a tie; one that no sequence has room for is cut over those with
    the most room, the cheaper and then the first one at a tie.
    """
    used, spent = [0] * bins, [0.0] * bins
    heap = [(0.0, 0, b) for b in range(bins)]
    # A sequence without room for this rest may have room for the smaller ones to come, so it is only set aside.
    aside: list[tuple[int, float, int]] = []
    put: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]

    def place(d: int, start: int, n: int, b: int) -> None:
        put[b].append((d, start, n))
        used[b] += n
        spent[b] += cost(n)

    for n, d in rests:
        # Those set aside come back once the rest is small enough for their room.
        while aside and -aside[0][0] >= n:
            _, c, b = heapq.heappop(aside)
            heapq.heappush(heap, (c, used[b], b))
        chosen = None
        while heap:
            c, _, b = heapq.heappop(heap)
            if size - used[b] >= n:
                chosen = b
                break
            heapq.heappush(aside, (-(size - used[b]), c, b))
        if chosen is not None:
            place(d, lengths[d] - n, n, chosen)
            heapq.heappush(heap, (spent[chosen], used[chosen], chosen))
            continue
        # No sequence has room for it: it is cut over those with the most room.
        start = lengths[d] - n
        while n:
            _, _, b = heapq.heappop(aside)
            take = min(n, size - used[b])
            place(d, start, take, b)
            start, n = start + take, n - take
            if used[b] < size:
                heapq.heappush(aside, (-(size - used[b]), spent[b], b))
    return put, used


def pack(lengths: list[int], size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts."""
    pieces, made = [], 0
    rests = []
    for d, n in enumerate(lengths):
        whole = n // size
        pieces += [(d, k * size, size, made + k, 0) for k in range(whole)]
        made += whole
        if n % size:
            rests.append((n % size, d))
    rests.sort(key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _ in rests)
    bins = -(-total // size)
    put, used = assigned(rests, lengths, bins, size)

    # All room that is left is moved into one sequence: from the emptiest, pieces go where there is room.
    order = sorted(range(bins), key=lambda b: (used[b], b))
    lo, hi = 0, bins - 1
    while lo < hi:
        b, into = order[lo], order[hi]
        room = size - used[into]
        if not room:
            hi -= 1
            continue
        if not put[b]:
            lo += 1
            continue
        d, start, n = put[b].pop()
        take = min(n, room)
        used[b] -= take
        if take < n:
            put[b].append((d, start, n - take))
        put[into].append((d, start + n - take, take))
        used[into] += take
    for b in range(bins):
        parts = put[b]
        left = used[b]
        step = size
        while left:
            # A short sequence ends at powers of two.
            while step > left:
                step //= 2
            at = 0
            while at < step:
                d, start, n = parts.pop()
                take = min(n, step - at)
                if take < n:
                    parts.append((d, start + take, n - take))
                pieces.append((d, start, take, made, at))
                at += take
            left -= step
            made += 1
    return pieces


def pack_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece.

    ``path`` names a tokenizers file that every executor can open; by default
    the public word BPE of 49k, of which words are remembered. Sequence ids are unique, not gapless.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path or public_tokenizers.path("word_bpe_49k.json"))
        memo = TextIds(tokenizer) if path else WordIds(tokenizer)
        task = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        made = tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            pieces = pack([len(x[1]) // 4 for x in held])
            rows = [
                (held[d][0], start, n, zlib.crc32(held[d][1][4 * start : 4 * (start + n)]), len(held[d][1]) // 4, task + made + s, at)
                for d, start, n, s, at in pieces
            ]
            made += 1 + max(p[3] for p in pieces)
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_arrow), *[pa.array(c, pa.int64()) for c in cols[1:]]], names)

        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        id_arrow = None
        for b in batches:
            id_arrow = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = memo.of(text.as_py())
                held.append((key, ids))
                tokens += len(ids) // 4
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    out = df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
