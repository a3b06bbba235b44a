"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint bit is set where more than half of a text's shingle hashes have it
set. Two fingerprints are linked if few bits differ; a document's component is
everything reachable over links.

The index is a hierarchy of masked bit patterns. Its upper nodes fix blocks of
bits: codes within ``radius`` differences agree on at least one of
``radius + 1`` blocks, so each code goes under one node for each block, and a
node that gets more than ``NODE_ROWS`` codes is opened by the blocks of its free
bits. With 12 free bits left a node has at most 4,096 different codes, so every
node is bounded. Below, a node's codes are sorted by Gray rank, which puts codes
with few differences side by side; runs of codes are merged into nodes that keep
the bits their codes share. A pair of nodes is followed down only while the
differences between their shared bits, accumulated on the way, are within the
radius, so whole groups are pruned at once.

Within a node the links found are reduced to a spanning star, so what leaves it
is linear in its codes. Components then come from alternating large-star and
small-star steps over written tables; nothing is collected to the driver.

Documents of a given Jaccard similarity (:func:`similar_documents`) are candidates
of the same index, over bands of a longer fingerprint of their distinct shingles; a
candidate is linked only once the exact similarity of the two sets says so. What the
index misses is found by an exact join on the sets' first shingles (:func:`missed`), for
documents that are not together yet, so no link is lost.

Nulls and odd input: a null text and a text without words have fingerprint zero,
linked like any other. Null ids are rows like any other; a component's id is the
smallest id that is not null (null if there is none). Repeated rows and exact
copies each keep their row. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import drop_written, hot_join, spread_join, tables_made, written

SEED = 42
#: Codes under an index node before it is opened; 4,096 or more, so that 12 free bits always fit.
NODE_ROWS = 4096
#: Sons of a node in the local hierarchy.
FANOUT = 8
#: Rows of one code from which they are led (see _led).
RUN = 32
#: Bytes of a row of a few numbers in a broadcast table, at most.
ROW_BYTES = 96
#: Pairs of nodes held at once.
FRONTIER = 1 << 16
#: Rows gathered before finished nodes are processed.
BUFFER = 1 << 16


# -- fingerprints ---------------------------------------------------------------------------------


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64-bit hash from a first one (a finaliser in the manner of splitmix64); lane 0 is the hash itself."""
    if lane == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * lane) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(h: np.ndarray, step: int = 1 << 16) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), step):
        counts += np.unpackbits(h[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, or of the whole sequence if it has fewer; A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, size: int = 3, lanes: int = 1) -> list[int]:
    """``lanes`` 64-bit fingerprints of a text, each from its own hash of the shingles."""
    h = shingle_hashes(text, size)
    with np.errstate(over="ignore"):
        return [_majority(_mixed(h, k)) if len(h) else 0 for k in range(lanes)]


def fingerprints(df: DataFrame, size: int, lanes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, wide): big-endian fingerprints of ``lanes`` times 64 bits, for each row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = [b"".join(x.to_bytes(8, "big") for x in fingerprint(t.as_py(), size, lanes)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wide, pa.binary())], ["id", "wide"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, wide binary")


# -- the index ------------------------------------------------------------------------------------


def block_masks(bits: int, radius: int, level: int) -> list[int]:
    """For each way down to this level, the mask of the bits that are fixed there."""
    ways = [(0, list(range(bits)))]
    for _ in range(level):
        deeper = []
        for fixed, free in ways:
            cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
            for i in range(radius + 1):
                block = free[cuts[i] : cuts[i + 1]]
                deeper.append((fixed | sum(1 << b for b in block), free[: cuts[i]] + free[cuts[i + 1] :]))
        ways = deeper
    return [fixed for fixed, _ in ways]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(code):
    """Place of a code in Gray order, as a signed long that sorts in that order."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest index reachable) after joining the pairs."""
    while True:
        a, b = labels[i], labels[j]
        if np.array_equal(a, b):
            return labels
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while not np.array_equal(labels[labels], labels):
            labels = labels[labels]


def code_pairs(codes: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (u, v), u < v, of codes under the same node (``group``, sorted) within ``radius``, each node's codes in Gray order."""
    n = len(codes)
    # levels[k]: for each node its first son (or code), AND and OR of its codes, and its group.
    first, both, some, own = np.arange(n + 1), codes, codes, group
    levels = [(None, both, some)]
    while True:
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        if len(starts) == len(own) and len(levels) > 1:
            break
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        heads = np.flatnonzero(place % FANOUT == 0)
        both, some = np.bitwise_and.reduceat(both, heads), np.bitwise_or.reduceat(some, heads)
        first, own = np.append(heads, len(own)), own[heads]
        levels.append((first, both, some))
    roots = np.arange(len(own))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        k, u, v = stack.pop()
        if len(u) > FRONTIER:
            half = len(u) // 2
            stack += [(k, u[:half], v[:half]), (k, u[half:], v[half:])]
            continue
        first, both, some = levels[k]
        if k == 0:
            near = (u < v) & (_popcount(codes[u] ^ codes[v]) <= radius)
            if near.any():
                yield u[near], v[near]
            continue
        nu, nv = first[u + 1] - first[u], first[v + 1] - first[v]
        each = nu * nv
        if each.sum() > 4 * FRONTIER and len(u) > 1:
            half = len(u) // 2
            stack += [(k, u[:half], v[:half]), (k, u[half:], v[half:])]
            continue
        pair = np.repeat(np.arange(len(u)), each)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        a, b = first[u][pair] + at // nv[pair], first[v][pair] + at % nv[pair]
        keep = a <= b
        _, both, some = levels[k - 1]
        # Bits that all codes of both nodes share, and differ between them.
        apart = (both[a] & ~some[b]) | (both[b] & ~some[a])
        keep &= _popcount(apart) <= radius
        stack.append((k - 1, a[keep], b[keep]))


def local_links(codes: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Component labels of codes under the same node."""
    labels = np.arange(len(codes))
    for u, v in code_pairs(codes, group, radius):
        labels = _join_labels(labels, u, v)
    return labels


def _led(codes: np.ndarray, group: np.ndarray, near: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that stay, followers, their leaders).

    Of more than ``RUN`` rows of one code, those within ``sure`` of an earlier one
    follow it and leave, so copies cost a comparison each.
    """
    stay, followers, leaders = np.ones(len(codes), bool), [], []
    starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (group[1:] != group[:-1]))))
    sizes = np.diff(np.append(starts, len(codes)))
    for start, size in zip(starts[sizes > RUN].tolist(), sizes[sizes > RUN].tolist(), strict=True):
        rest = np.arange(start, start + size)
        while len(rest) > 1:
            close = _popcount(near[rest[1:]] ^ near[rest[0]]).sum(axis=1) <= sure
            followers.append(rest[1:][close])
            leaders.append(np.full(int(close.sum()), rest[0]))
            rest = rest[1:][~close]
    followers = np.concatenate(followers) if followers else np.zeros(0, np.int64)
    stay[followers] = False
    return np.flatnonzero(stay), followers, np.concatenate(leaders) if leaders else np.zeros(0, np.int64)


def _forest(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs that span all pairs, the nearest ones first: a minimum spanning forest, up to a few pairs more at ties."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    labels, chosen = np.arange(len(nodes)), []
    order = np.argsort(d, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(d[order])) + 1):
        while len(level := level[labels[a[level]] != labels[b[level]]]):
            # One pair for each tree that has any.
            _, at = np.unique(np.concatenate([labels[a[level]], labels[b[level]]]), return_index=True)
            taken = level[np.unique(at % len(level))]
            chosen.append(taken)
            labels = _join_labels(labels, a[taken], b[taken])
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def local_candidates(codes: np.ndarray, group: np.ndarray, near: np.ndarray, radius: int, sure: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows under the same node that span all candidates: codes within ``radius``, near fingerprints within ``most``.

    What is given is a forest of the nearest pairs, so it is linear in the rows; two
    candidates are joined by pairs that are no farther apart than they are.
    """
    stay, a, b = _led(codes, group, near, sure)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, d = (np.concatenate(c) for c in zip(*held, strict=True))
        keep = _forest(u, v, d)
        return u[keep], v[keep], d[keep]

    for x, y in code_pairs(codes[stay], group[stay], radius):
        u, v = stay[x], stay[y]
        d = np.concatenate([_popcount(near[u[s : s + 65536]] ^ near[v[s : s + 65536]]).sum(axis=1, dtype=np.int64) for s in range(0, len(u), 65536)])
        maybe = d <= most
        held.append((u[maybe], v[maybe], d[maybe]))
        if sum(len(h[0]) for h in held) > FRONTIER:
            held = [joined()]
    u, v, _ = joined()
    return np.concatenate([a, u]), np.concatenate([b, v])


def _star_edges(radius: int):
    """A mapInArrow function: rows (way, pattern, code, node) in order -> edges (a, b) to each local root."""

    def solve(code: np.ndarray, node: np.ndarray, group: np.ndarray, _: None) -> tuple[np.ndarray, np.ndarray]:
        labels = local_links(code, group, radius)
        moved = node != node[labels]
        return node[moved], node[labels][moved]

    return _by_nodes(solve)


def _candidate_edges(radius: int, sure: int, most: int):
    """A mapInArrow function: rows (way, pattern, code, node, near) in order -> pairs (a, b) to be verified."""

    def solve(code: np.ndarray, node: np.ndarray, group: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = local_candidates(code, group, near, radius, sure, most)
        return node[u], node[v]

    return _by_nodes(solve)


def _by_nodes(solve: Callable):
    """Hands whole nodes of the index, many at a time, to ``solve`` (codes, nodes, group, near fingerprints or None) -> (a, b)."""

    def solved(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        way, pattern, code, node, near = cols
        group = np.cumsum(np.concatenate(([0], (way[1:] != way[:-1]) | (pattern[1:] != pattern[:-1]))))
        many = np.bincount(group)[group] > 1
        code, node, group, near = code[many], node[many], group[many], None if near is None else near[many]
        if not len(code):
            return None
        a, b = solve(code.view(np.uint64), node, group, near)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        near = None
        if b.num_columns > 4:
            near = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(b.num_rows, -1)
        return [*cols, near]

    def joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [None if h[0] is None else np.concatenate(h) for h in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(arrays(b))
            rows += b.num_rows
            if rows >= BUFFER:
                cols = joined(held)
                way, pattern = cols[0], cols[1]
                # The last node may go on in the next batch.
                cut = int(np.flatnonzero((way != way[-1]) | (pattern != pattern[-1]))[-1]) + 1 if (way[0], pattern[0]) != (way[-1], pattern[-1]) else 0
                if cut and (out := solved([None if c is None else c[:cut] for c in cols])) is not None:
                    yield out
                held = [[None if c is None else c[cut:] for c in cols]]
                rows -= cut
        if rows and (out := solved(joined(held))) is not None:
            yield out

    return run


def similar_edges(codes: DataFrame, bits: int, radius: int, near: tuple[int, int] | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) between nodes that span the links of ``codes``.

    ``codes`` is (node, code, band[, near]), cheap to read again, each (band, code, node) once; only codes of a band are compared.
    With ``near``, the radii of :func:`local_candidates`, they are candidates that are to be verified.
    """
    extra = ["near"] if near else []
    local = _candidate_edges(radius, *near) if near else _star_edges(radius)
    found, level = None, 0
    rows = codes.withColumn("way", F.lit(0))
    while True:
        level += 1
        masks = block_masks(bits, radius, level)
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        sons = F.explode(F.sequence(F.lit(0), F.lit(radius)))
        rows = rows.withColumn("son", sons).withColumn("way", F.col("way") * (radius + 1) + F.col("son")).drop("son")
        rows = rows.withColumn("pattern", F.col("code").bitwiseAND(F.get(table, F.col("way"))))
        free = bits - min(m.bit_count() for m in masks)
        key = ["band", "way", "pattern"]
        hot = None
        if free > 12:
            sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows).select(*key)
            hot = written(sizes, "hot-nodes")
            if not (n_hot := hot.count()):
                hot = None
        now = rows
        if hot is not None:
            # A hot node may hold a third of all codes.
            marked = written(spread_join(rows, hot.withColumn("hot", F.lit(True)), key, n_hot * ROW_BYTES, ["node"], "left"), "marked")
            now, rows = marked.where("hot IS NULL").drop("hot"), marked.where("hot").drop("hot", "pattern")
        dealt = now.select((F.col("band") * len(masks) + F.col("way")).cast("long").alias("way"), "pattern", "code", "node", *extra)
        ordered = dealt.repartition("way", "pattern").sortWithinPartitions("way", "pattern", gray_rank(F.col("code")), "node")
        edges = ordered.mapInArrow(local, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if hot is None:
            return found


# -- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that an edge names.

    Large-star: every larger neighbour of a node is linked to the smallest in its
    neighbourhood; small-star: the node and its smaller neighbours are. Both
    preserve components; when nothing changes, all edges lead to the root.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, small: bool, n_edges: int) -> DataFrame:
        # pairs: (u, v) as seen from u. The smallest of a neighbourhood is a row for each u, of which there are two an edge at most.
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        both = spread_join(pairs, low, ["u"], 2 * n_edges * ROW_BYTES, ["v"])
        if small:
            out = both.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = mark(now)
    while seen[0]:
        two_way = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(two_way, False, seen[0])
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # Large-star gives no more edges than it got.
        after = written(star(down, True, seen[0]), "edges")
        got = mark(after)
        drop_written(spark, now)
        now = after
        if got == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


# -- the operators --------------------------------------------------------------------------------


#: Labels of the tables that what :func:`_grouped` gives still reads.
GROUPED = ("edges", "rooted")


def _grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, node, component_id) from written rows (id, node) and the :func:`components` of the nodes."""
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A root may have a third of all nodes: its smallest id is aggregated first, then handed out skew-safe.
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = written(rooted.select("node", "root"), "rooted")
    of_node = hot_join(rooted, ids, "root").select("node", "component_id")
    return hot_join(rows, of_node, "node")


def near_duplicates(df: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """(id, fingerprint, component_id): fingerprints of 64 bits over ``size``-word shingles, linked at ``radius`` or fewer differing bits."""
    wide = fingerprints(df, size, 1, id_col, text_col)
    rows = written(wide.select("id", F.conv(F.hex("wide"), 16, -10).cast("long").alias("node")), "fingerprints")
    with tables_made(df.sparkSession) as drop_but:
        codes = written(rows.select("node").distinct().select("node", F.col("node").alias("code"), F.lit(0).alias("band")), "codes")
        edges = similar_edges(codes, 64, radius, node_rows=node_rows)
        out = _grouped(rows, components(edges))
        drop_but(GROUPED)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


#: The long fingerprint of :func:`similar_documents`: lanes of 64 bits, bands of it that are indexed, and their radius.
LANES, BANDS, BAND_BITS, BAND_RADIUS = 4, 8, 32, 2
#: Lanes that go into the index with each code.
NEAR_LANES = 4
#: Standard deviations beyond the mean distance at the similarity asked for up to which candidates are verified, and below it up to which rows of one code follow a leader.
SLACK, SURE = 2.5, 1.0
#: Rows of one key in the joins of the verification; a busier document is handed out in more parts.
PART = 256
#: Buckets of the first, bounded filter for documents with a candidate; a power of two.
BUCKETS = 1 << 20
#: Texts whose shingles are counted for the order of the exact join: one in SAMPLE_SHARE, but so many at least and at most.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 20, 4_000, 100_000
#: Sampled texts that hold a shingle from which it is common, and common shingles that are put last, at most.
COMMON, COMMON_MOST = 3, 1_000_000
#: Bits of a set's parities; a multiple of 64.
PARITIES = 1024
#: Rows of one shingle that are compared in one piece; more are dealt out in pairs of parts.
TOGETHER = 4096


def near_radius(similarity: float, deviations: float, lanes: int = NEAR_LANES) -> int:
    """Differing bits at this Jaccard similarity, so many standard deviations off the mean.

    A bit differs with probability arccos(cosine) / pi, and for sets of a given
    Jaccard similarity J the cosine is least, 2J / (1 + J), at equal sizes.
    """
    bits, p = 64 * lanes, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return max(0, int(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, size))


def set_node(shingles: np.ndarray) -> int:
    """A number that stands for a set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def least_common(n, thousandths: int):
    """Shingles that a set of ``n`` has in common with any other of this similarity, at least."""
    return -(-thousandths * n // 1000)


def _common(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles that several of a sample of the texts (digest, text) hold, in order.

    They only say in which order shingles are joined: any order gives the same links, one that has common shingles last fewer candidates.
    """
    total = rows.count()
    share = min(max(total // SAMPLE_SHARE, SAMPLE_LEAST), SAMPLE_MOST) / max(total, 1)
    some = rows.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), size).view(np.int64))], ["shingle"])

    texts = some.groupBy("digest").agg(F.first("text").alias("text")).select("text")
    counts = texts.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def first_shingles(shingles: np.ndarray, common: np.ndarray, thousandths: int) -> np.ndarray:
    """Of a set, the first shingles in an order that all sets share; two sets of this similarity have one of them in common."""
    if len(common) and len(shingles):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[: len(shingles) - least_common(len(shingles), thousandths) + 1] if len(shingles) else shingles


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of the shingles falls to i. Two sets differ in as many shingles, at least, as these differ in bits."""
    odd = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prints(df: DataFrame, size: int, common: np.ndarray, thousandths: int) -> DataFrame:
    """(id, digest, node, near, codes, n, firsts, parities) of rows (id, digest, text)."""
    id_type = df.schema["id"].dataType.simpleString()
    names = ["id", "digest", "node", "near", "codes", "n", "firsts", "parities"]
    common = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                nodes, wide, n, firsts, odd = [], [], [], [], []
                for t in b.column(2):
                    h = shingle_set(t.as_py(), size)
                    nodes.append(set_node(h))
                    n.append(len(h))
                    odd.append(parities(h))
                    firsts.append(first_shingles(h, common.value, thousandths).view(np.int64))
                    with np.errstate(over="ignore"):
                        wide.append(b"".join((_majority(_mixed(h, k)) if len(h) else 0).to_bytes(8, "big") for k in range(LANES)))
                bands = np.frombuffer(b"".join(wide), ">u4").astype(np.int64)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands))
                near = pa.array([w[: 8 * NEAR_LANES] for w in wide], pa.binary())
                cols = [pa.array(nodes, pa.int64()), near, codes, pa.array(n, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    schema = f"id {id_type}, digest long, node long, near binary, codes array<long>, n long, firsts array<long>, parities array<long>"
    return df.select("id", "digest", "text").mapInArrow(run, schema)


def shared_pairs(shingle: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, part: np.ndarray, thousandths: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (u, v) of rows of one shingle (rows in its order, then by ``n``) whose sets may have this similarity and are not under one root.

    ``place`` is the shingle's place in the set's order; rows of one part are not compared, but for part -1.
    """
    u, apart = np.arange(len(shingle) - 1), 1
    while len(u):
        v = u + apart
        # Sets further on are larger still.
        going = (shingle[u] == shingle[v]) & (n[u] * 1000 >= n[v] * thousandths)
        u, v = u[going], v[going]
        most = np.minimum(n[u] - place[u], n[v] - place[v])
        maybe = (root[u] != root[v]) & (most * (1000 + thousandths) >= thousandths * (n[u] + n[v])) & ((part[u] != part[v]) | (part[u] < 0))
        if maybe.any():
            yield u[maybe], v[maybe]
        apart += 1
        u = u[u + apart < len(shingle)]


def _shared(thousandths: int, together: int | None):
    """A mapInArrow function: rows (shingle, block, n, node, root, place, part) in order -> pairs (a, root_a, b, root_b).

    A shingle's rows are held whole, up to ``together`` of them; those of a more frequent one are
    given as they are, with b null and (node, root, shingle, n, place) in a, root_a, shingle, n, place.
    """
    names = ["a", "root_a", "b", "root_b", "shingle", "n", "place"]

    def solved(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingle, block, n, node, root, place, part = cols
        key = np.cumsum(np.concatenate(([0], (shingle[1:] != shingle[:-1]) | (block[1:] != block[:-1]))))
        low, high = (f.reduceat(root, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))) for f in (np.minimum, np.maximum))
        live = (low != high)[key]
        key, n, node, root, place, part = (c[live] for c in (key, n, node, root, place, part))
        for u, v in shared_pairs(key, root, n, place, part, thousandths):
            less = node[u] < node[v]
            a, b = np.where(less, u, v), np.where(less, v, u)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, (node[a], root[a], node[b], root[b])), none, none, none], names)

    def passed(cols: list[np.ndarray]) -> pa.RecordBatch:
        shingle, _, n, node, root, place, _ = cols
        none = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), none, none, pa.array(shingle), pa.array(n), pa.array(place)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide = None, None
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = now if held is None else [np.concatenate(c) for c in zip(held, now, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            # The last shingle may go on in the next batch.
            done, held = [c[:cut] for c in cols], [c[cut:] for c in cols]
            if together:
                start = np.flatnonzero(np.concatenate(([True], done[0][1:] != done[0][:-1]))) if cut else np.zeros(0, np.int64)
                sizes = np.diff(np.append(start, cut))
                large = np.repeat((sizes > together) | (done[0][start] == wide if wide is not None and cut else False), sizes)
                if large.any():
                    yield passed([c[large] for c in done])
                    done = [c[~large] for c in done]
                if len(held[0]) > together or (wide is not None and len(held[0]) and held[0][0] == wide):
                    wide = held[0][0]
                    yield passed(held)
                    held = None
                elif cut:
                    wide = None
            if len(done[0]):
                yield from solved(done)
        if held is not None and len(held[0]):
            if together and (len(held[0]) > together or held[0][0] == wide):
                yield passed(held)
            else:
                yield from solved(held)

    return run


def missed(nodes: DataFrame, roots: DataFrame, similarity: float, together: int = TOGETHER) -> DataFrame:
    """(a, root_a, b, root_b): all pairs of nodes (node, n, firsts) under different roots that may have this similarity.

    Sets of a Jaccard similarity t share one of their first n - ceil(t n) + 1 shingles, whatever the order (prefix
    filter), so no pair is missing; sizes, and the places of the shared shingle, rule out most that share one. A shingle of
    more than ``together`` rows under several roots is dealt out in pairs of parts of that size.
    """
    thousandths = round(similarity * 1000)
    kind = "a long, root_a long, b long, root_b long, shingle long, n long, place long"
    order = ["shingle", "block", "n", "node"]
    columns = ["shingle", "block", "n", "node", "root", "place", "part"]
    rooted = spread_join(nodes.select("node", "n", "firsts"), roots, ["node"], roots.count() * ROW_BYTES, ["node"], "left")
    rows = rooted.select("node", "n", F.nullif("root", "node").alias("root"), F.posexplode("firsts").alias("place", "shingle"))
    rows = rows.select("shingle", F.lit(0).cast("long").alias("block"), "n", "node", "root", F.col("place").cast("long").alias("place"), F.lit(-1).cast("long").alias("part"))
    # Most nodes are alone: a root that is the node itself is filled in behind the shuffle.
    dealt = rows.repartition("shingle").sortWithinPartitions(*order).withColumn("root", F.coalesce("root", "node"))
    found = written(dealt.mapInArrow(_shared(thousandths, together), kind), "shared")
    pairs, wide = found.where("b IS NOT NULL").select("a", "root_a", "b", "root_b"), found.where("b IS NULL")
    sizes = wide.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("root_a").alias("low"), F.max("root_a").alias("high")).where("low <> high")
    sizes = written(sizes.select("shingle", F.ceil(F.col("rows") * 2 / together).alias("parts")), "wide")
    if n_wide := sizes.count():
        dealt = spread_join(wide, sizes, ["shingle"], n_wide * ROW_BYTES, ["a"])
        part = F.pmod(F.xxhash64(F.col("a")), F.col("parts"))
        dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        block = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
        # In the block of a part with itself all rows are compared, in the others those of different parts.
        dealt = dealt.withColumns({"block": block, "part": F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part"))})
        dealt = dealt.select("shingle", "block", "n", F.col("a").alias("node"), F.col("root_a").alias("root"), "place", F.col("part").cast("long").alias("part"))
        more = dealt.select(*columns).repartition("shingle", "block").sortWithinPartitions(*order).mapInArrow(_shared(thousandths, None), kind)
        pairs = pairs.unionByName(more.select("a", "root_a", "b", "root_b"))
    return pairs.distinct()


def _parted(edges: DataFrame) -> DataFrame:
    """Adds ``a_part`` and ``b_part``: a node of many edges is handed out in parts of about ``PART``."""
    for side, other in (("a", "b"), ("b", "a")):
        counts = edges.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        part = F.pmod(F.xxhash64(other), F.ceil(F.col("n") / PART)).cast("int")
        edges = written(hot_join(edges, counts, side).withColumn(f"{side}_part", part).drop("n"), "parted")
    return edges


def _with_set(rows: DataFrame, edges: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """Adds the shingle set of one side of each of the :func:`_parted` edges to ``rows``, which has them."""
    copies = edges.select(F.col(side).alias("node"), F.col(f"{side}_part")).distinct()
    handed = sets.join(copies.hint("shuffle_hash"), "node").withColumnsRenamed({"node": side, "shingles": f"{side}_set"})
    return rows.join(handed.hint("merge"), [side, f"{side}_part"])


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b), a written table, whose shingle sets (node, shingles) have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few at a time: sets are as long as their texts.
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                good = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    # In whole numbers, as far as the similarity is one of thousandths.
                    good.append(common * 1000 >= round(similarity * 1000) * (len(x) + len(y) - common))
                yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # The parts are settled on bare edges, so that sets, once added, are shuffled once more only.
    edges = _parted(edges)
    one = _with_set(edges, edges, sets, "a")
    return _with_set(one, edges, sets, "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def _sets(df: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the texts (digest, text) whose digest is wanted, a row for each node."""
    near = F.broadcast(wanted.select(F.col("digest").bitwiseAND(BUCKETS - 1).alias("bucket")).distinct())
    some = df.select("digest", "text").withColumn("bucket", F.col("digest").bitwiseAND(BUCKETS - 1)).join(near, "bucket", "left_semi").drop("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h = shingle_set(b.column(1)[k].as_py(), size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([set_node(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())], ["digest", "node", "shingles"])

    # Copies of a text have its digest; one of them is enough, and a hot text is one row after the partial step.
    texts = some.groupBy("digest").agg(F.first("text").alias("text"))
    exact = texts.join(wanted.select("digest").hint("shuffle_hash"), "digest", "left_semi")
    return exact.mapInArrow(run, "digest long, node long, shingles binary").select("node", "shingles")


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs, a written table, without those whose parities say that they have not this similarity; whole sets are for the others only."""
    sets = nodes.select("node", "n", "parities")
    half = written(hot_join(pairs, sets.withColumnsRenamed({"node": "a", "n": "n_a", "parities": "of_a"}), "a"), "half-parities")
    both = hot_join(half, sets.withColumnsRenamed({"node": "b", "n": "n_b", "parities": "of_b"}), "b")
    differ = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    # So similar sets of n_a and n_b shingles differ in (1 - t) / (1 + t) of n_a + n_b at most.
    thousandths = round(similarity * 1000)
    return both.where(differ * (1000 + thousandths) <= (1000 - thousandths) * (F.col("n_a") + F.col("n_b"))).select(pairs.columns)


def _linked(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b), a written table, of this similarity, written."""
    with tables_made(rows.sparkSession) as drop_but:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = written(nodes.select("node", "digest").join(ends.hint("shuffle_hash"), "node", "left_semi"), "wanted")
        sets = written(_sets(rows, size, wanted), "shingle-sets")
        links = written(verified(pairs, sets, similarity), "links")
        drop_but(("links",))
    return links


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, written."""
    return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "rooted")


def _completed(rows: DataFrame, nodes: DataFrame, roots: DataFrame, size: int, similarity: float) -> DataFrame:
    """The components of the nodes with all links, from components by some of them."""
    left = written(_possible(written(missed(nodes, roots, similarity), "maybe"), nodes, similarity), "missed")
    n_left = left.count()
    if n_left > max(nodes.count(), TOGETHER):
        # Many pairs of few components: one of each two goes first, and those that it joins are not compared further.
        two = [F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y")]
        first = left.groupBy(*two).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
        now = _joined(roots, _linked(rows, nodes, written(first, "missed"), size, similarity))
        for c in ("root_a", "root_b"):
            again = now.select(F.col("node").alias(c), F.col("root").alias("now"))
            left = spread_join(left, again, [c], now.count() * ROW_BYTES, ["a", "b"], "left").withColumn(c, F.coalesce("now", c)).drop("now")
        left, roots = written(left.where("root_a <> root_b"), "missed"), now
        n_left = left.count()
    return _joined(roots, _linked(rows, nodes, left.select("a", "b"), size, similarity)) if n_left else roots


def similar_documents(df: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """(id, component_id): documents linked at a Jaccard similarity of ``similarity`` or more of their ``size``-word shingles.

    Candidates have one of ``BANDS`` 32-bit bands of their fingerprints within two
    bits, which the index finds exactly, and 256 bits within :func:`near_radius`; each
    link is verified on the whole shingle sets. The pairs that meet in no band, or are
    joined by a chain of candidates that are not alike, come from :func:`missed`, verified in the same way.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("digest"), F.col(text_col).alias("text"))
    spark = df.sparkSession
    prints = written(_prints(rows, size, _common(rows, size), round(similarity * 1000)), "fingerprints")
    ids = written(prints.select("id", "node"), "ids")
    with tables_made(spark) as drop_but:
        kept = [F.first(c).alias(c) for c in ("near", "codes", "n", "firsts", "parities")]
        nodes = written(prints.groupBy("node").agg(F.min("digest").alias("digest"), *kept), "nodes")
        drop_written(spark, prints)
        codes = nodes.select("node", "near", F.posexplode("codes").alias("band", "code"))
        radii = near_radius(similarity, -SURE), near_radius(similarity, SLACK)
        pairs = written(similar_edges(codes, BAND_BITS, BAND_RADIUS, radii, node_rows).distinct(), "candidates")
        roots = written(components(_linked(rows, nodes, pairs, size, similarity)), "rooted")
        drop_but(("nodes", "rooted"))
        out = _grouped(ids, _completed(rows, nodes, roots, size, similarity))
        drop_but(GROUPED)
    return out.select(F.col("id").alias(id_col), "component_id")
