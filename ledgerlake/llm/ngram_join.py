"""N-gram Jaccard self-join by signature trees (operator 9).

Documents are sets of hashed word shingles. Equal sets are one node from the start. A forest of signature trees holds
the rest, dealt by what every pair over the threshold shares: the whole content of some part of the hash space (it
differs in fewer shingles than there are parts); or, with all shingles in one order, rare ones first, one of the first
few of either set, so that passages which many documents hold join nothing, and shingles of one document aren't dealt
at all. For that, shingles are counted by ranges of their hashes, each range in one task; what comes back is a bitmap of
those that several rows hold, of bounded size. Trees that share nodes become one.
In a tree, nodes lie in bands of size, then in blocks, then in a hierarchy; each level holds the OR of the token
bitmaps and the range of sizes below it. Two trees, or a tree and itself, are traversed together, and a pair of nodes
is dropped when its largest possible overlap can't reach the threshold. What is left at the leaves is compared exactly;
pairs that are connected already aren't compared, so a large group costs about one comparison for each member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bloom
from ledgerlake.llm.common import bounded_batches, fresh, staged, table, tidy
from ledgerlake.llm.components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words whose hashes a worker remembers; nodes of a block; children of a tree node; bits of a bitmap; sets whose keys a
#: task knows to have sent.
MEMO, BLOCK, FAN, BITS, SENT = 50_000, 256, 8, 2048, 200_000
#: Nodes, and shingles, of a block of a cluster that is larger than BLOCK; how often such clusters are dealt anew; pairs of
#: tree nodes that are compared at once.
LARGE_BLOCK, BLOCK_SHINGLES, ROUNDS, PAIRS = 1024, 1 << 20, 3, 1 << 16
#: Leading bits of a shingle's hash by which it is counted; by which it is known, at most, whether several rows hold it; and
#: by which it is known how common those that several hold are.
POSITION, CELLS, COUNTERS = 38, 28, 24
#: Bytes of text for each range in which shingles are counted, bits of a range's number, and shingles that are sent at once.
RANGE_BYTES, RANGES, HELD = 4 << 20, (8, 17), 1 << 20
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, width: int, memo: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles: A-Z lower-cased, words between [\\x20\\x09-\\x0D], ``width``
    words each; with fewer words the whole sequence as one; none without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * M1 + h[k : k + n])
    return np.unique(out)


class Rarity(NamedTuple):
    """Bits of the cells in which several rows hold a shingle, and a byte for each counter of how common those are, packed."""

    repeated: bytes
    levels: bytes

    def unpacked(self) -> Levels:
        return Levels(*(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in self))


class Levels(NamedTuple):
    repeated: np.ndarray
    levels: np.ndarray

    def of(self, s: np.ndarray) -> np.ndarray:
        """0 of shingles that one row has at most, else about the logarithm of how many rows have them."""
        cell, at = (s >> np.uint64(65 - len(x).bit_length() - k) for x, k in ((self.repeated, 3), (self.levels, 0)))
        bit = self.repeated[cell >> np.uint64(3)] >> (~cell & np.uint64(7)).astype(np.uint8) & 1
        return np.where(bit, self.levels[at], np.uint8(0))


@tidy
def _positions(batches: Iterator[pa.RecordBatch], width: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Positions that a task's rows hold and by how many rows, up to 255, by range: (range, low, high), gaps between
    positions in two parts, of which the lower can't be packed."""
    memo, held, size, pack = WordHashes(), [], 0, zstandard.ZstdCompressor(level=1).compress
    first = np.arange((1 << ranges) + 1, dtype=np.uint64) << np.uint64(POSITION - ranges)

    def sent() -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held) >> np.uint64(64 - POSITION), return_counts=True)
        ends, n = np.searchsorted(at, first), np.minimum(n, 255).astype(np.uint8)
        full = np.flatnonzero(np.diff(ends))
        low, high = [], []
        for r in full.tolist():
            a, b = ends[r], ends[r + 1]
            gaps = np.diff(at[a:b], prepend=first[r]).astype("<u8")
            low.append(gaps.astype("<u2").tobytes())
            high.append(pack(gaps.view(np.uint8).reshape(-1, 8)[:, 2:5].T.tobytes() + n[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["range", "low", "high"])

    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            held.append(shingles(text, width, memo))
            size += len(held[-1])
            if size >= HELD:
                yield sent()
                held, size = [], 0
    if size:
        yield sent()


def gaps_of(low: bytes, high: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions from the start of a range, and how many rows have each, from what _positions sends."""
    gaps = np.zeros((len(low) // 2, 8), np.uint8)
    gaps[:, :2] = np.frombuffer(low, np.uint8).reshape(-1, 2)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(high), np.uint8).reshape(4, -1)
    gaps[:, 2:5] = rest[:3].T
    return np.cumsum(gaps.view("<u8").reshape(-1), dtype=np.uint64), rest[3]


@tidy
def _repeated(batches: Iterator[pa.RecordBatch], ranges: int, cells: int, counters: int) -> Iterator[pa.RecordBatch]:
    """Rows of _positions in order of range, to the range's part of a Rarity: (range, repeated, levels)."""
    held, now, pack = [], None, zstandard.ZstdCompressor(level=1).compress

    def done() -> pa.RecordBatch:
        at, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.argsort(at)
        at, n = at[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        total = np.add.reduceat(n, start)
        at, total = at[start][total > 1], total[total > 1]
        bits = np.zeros(1 << (cells - ranges), bool)
        bits[at >> np.uint64(POSITION - cells)] = True
        sums = np.bincount((at >> np.uint64(POSITION - counters)).astype(np.int64), total, 1 << (counters - ranges))
        levels = np.ceil(np.log2(sums + 1)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([pack(x.tobytes())], pa.binary()) for x in (np.packbits(bits), levels))], names=["range", "repeated", "levels"])

    for batch in batches:
        for r, low, high in zip(*(batch.column(c).to_pylist() for c in ("range", "low", "high")), strict=True):
            if r != now:
                if now is not None:
                    yield done()
                held, now = [], r
            held.append(gaps_of(low, high))
    if now is not None:
        yield done()


def rarity(rows: DataFrame, width: int) -> Rarity:
    """Which shingles several rows have, and about how many. A position is only ever taken for a repeated one by mistake:
    by a shingle in the same cell, which is rare up to CELLS bits and makes more keys beyond, never fewer."""
    n = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounded = lambda x, lo, hi: max(lo, min(hi, x.bit_length()))
    ranges, cells = bounded(n // RANGE_BYTES, *RANGES), bounded(n // 8, 20, CELLS)
    counters = min(cells, COUNTERS)
    sent = rows.select("text").mapInArrow(partial(_positions, width=width, ranges=ranges), "range int, low binary, high binary")
    parts = sent.repartition("range").sortWithinPartitions("range").mapInArrow(partial(_repeated, ranges=ranges, cells=cells, counters=counters), "range int, repeated binary, levels binary")
    out, unpack = [np.zeros((1 << ranges, 1 << (bits - ranges)), np.uint8) for bits in (cells - 3, counters)], zstandard.ZstdDecompressor().decompress
    for r in parts.toLocalIterator():
        for x, c in zip(out, ("repeated", "levels"), strict=True):
            x[r["range"]] = np.frombuffer(unpack(r[c]), np.uint8)
    return Rarity(*(zstandard.ZstdCompressor(level=3).compress(x.tobytes()) for x in out))


@lru_cache(None)
def size_class(c: int, num: int, den: int) -> tuple[int, int, int, int]:
    """Of size class c: its least size, the next class's, the number of parts, and the empty parts that may go unkeyed.

    A pair within the class differs in at most d shingles, so of d + 1 + z parts at least z + 1 agree. A set with at most
    z empty parts has a part among them that isn't empty; a set with more keys its empty parts too. z makes that rare.
    """
    ratio = max(1.25, den / num)
    least, following = math.ceil(ratio**c), math.ceil(ratio ** (c + 1))
    d = 2 * (following - 1) * (den - num) // (den + num)
    best = (2.0, 0)
    for z in range(1, d + 10):
        mean = (d + 1 + z) * math.exp(-least / (d + 1 + z))
        tail = math.exp(z + 1 - mean + (z + 1) * math.log(mean / (z + 1))) if 0 < mean < z + 1 else 1.0
        best = min(best, (max(tail, 1e-7), z))
    return least, following, d + 1 + best[1] if d else 1, best[1]


def classes_of(n: int, num: int, den: int) -> list[int]:
    """The size classes in which a set of n shingles may meet a similar one: its own, and the next if that's in reach."""
    c = max(0, int(math.log(n) / math.log(max(1.25, den / num))) - 1)
    while size_class(c, num, den)[1] <= n:
        c += 1
    return [c, c + 1] if n * den >= num * size_class(c, num, den)[1] else [c]


def part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """A hash of each part's content, by size class; parts are equal ranges of the hash space."""
    out = []
    for c in classes_of(len(s), num, den) if len(s) else []:
        _, _, parts, spare = size_class(c, num, den)
        if parts == 1:
            continue  # only equal sets can be similar, and those are one node
        width = np.uint64((1 << 64) // parts + 1)
        edges = np.searchsorted(s, np.arange(parts, dtype=np.uint64) * width)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ M1), dtype=np.uint64)])
        ends = np.append(edges[1:], len(s))
        count = (ends - edges).astype(np.uint64)
        label = np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)
        keys = mixed(mixed(label * M1 + count) + total[ends] - total[edges])
        out.append(keys if np.count_nonzero(count == 0) > spare else keys[count > 0])
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def prefix_keys(s: np.ndarray, levels: Levels, num: int, den: int) -> np.ndarray:
    """The set's first shingles in the order of all shingles, rare ones first: so many that two sets over the threshold
    have one of them in common, as they share num / den of either. Those that no other row has are left out."""
    keep, level = len(s) - (num * len(s) + den - 1) // den + 1, levels.of(s)
    order = np.lexsort((s, level))[:keep]
    return s[order[level[order] > 0]].view(np.int64)


@tidy
def _profile(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, rare: Rarity | None) -> Iterator[pa.RecordBatch]:
    """Rows to the size and number of their sets, with keys: a task sends the keys of equal sets once, or again after
    SENT others, so that a large group of copies sends about as many as there are tasks."""
    memo, sent, none = WordHashes(), set(), np.empty(0, np.int64)
    levels = None if rare is None else rare.unpacked()
    for batch in batches:
        n, nodes, keys = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            s = shingles(text, width, memo)
            n.append(len(s))
            node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
            nodes.append(node)
            known = node is None or node in sent
            keys.append(none if known else part_keys(s, num, den) if levels is None else prefix_keys(s, levels, num, den))
            if len(sent) >= SENT:
                sent.clear()
            sent.add(node)
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = pa.array(np.concatenate([np.empty(0, np.int64), *keys]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "rk", "n", "node", "keys"])


@tidy
def _prefixes(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, rare: Rarity) -> Iterator[pa.RecordBatch]:
    memo, levels = WordHashes(), rare.unpacked()
    for batch in batches:
        keys = [prefix_keys(shingles(t, width, memo), levels, num, den) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *keys]), pa.int64()))], names=["node", "keys"])


def _trees(keyed: DataFrame) -> DataFrame:
    """(node, cluster, size): nodes that some key connects, from (node, keys)."""
    keyed = keyed.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    trees = connected_components(keyed.mapInArrow(_stars, "a long, b long")).select("node", F.col("root").alias("cluster"))
    return trees.join(trees.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) in this order: an edge from the first node of each key to each further one. Keys are runs,
    of which only the first node is held, however long they are."""
    last_key = last_node = None
    for batch in batches:
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        if not len(key):
            continue
        start = np.concatenate([[True], key[1:] != key[:-1]])
        first = node[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
        if last_key == key[0]:
            first = np.where(np.cumsum(start) == 1, last_node, first)
        last_key, last_node = key[-1], first[-1]
        edge = first != node
        pair = np.unique(np.stack([first[edge], node[edge]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        sets = [shingles(t, width, memo) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "band", "block", "node")), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "band", "block", "node", "s"])


class SignatureTree:
    """Levels from the leaves up. Of each tree node: OR of the bitmaps, least and largest size, fewest bits of a set below
    it, and the most by which a set's size exceeds its bits (shingles that share a bit)."""

    def __init__(self, sets: list[np.ndarray]):
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> np.uint64(20)) % np.uint64(BITS)
            np.bitwise_or.at(bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, size, size, ones, size - ones)]
        while len(self.levels[-1][1]) > 1:
            bits, lo, hi, ones, over = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(ones, at), np.maximum.reduceat(over, at)))

    def level(self, k: int) -> tuple:
        return self.levels[min(k, len(self.levels) - 1)]


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether some pair of sets below nodes i of a and j of b can reach the threshold.

    A shingle of a set that sets a bit which the other side's OR lacks isn't shared. So the overlap is at most the bits
    that both sides have, and the shingles that share a bit; and at most a set's size less its bits that the other side
    lacks. The threshold asks for an overlap of num / (den + num) of both sizes together.
    """
    near = (a[2][i] * den >= b[1][j] * num) & (b[2][j] * den >= a[1][i] * num)
    i, j = i[near], j[near]
    common = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64)
    most = np.minimum(common + np.minimum(a[4][i], b[4][j]), np.minimum(a[2][i], b[2][j]))
    near[near] = most * (den + num) >= num * (a[1][i] + b[1][j])
    return near


def candidates(a: SignatureTree, b: SignatureTree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the traversal leaves; of a tree with itself, each pair once."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        if k < top:
            ways = np.arange(FAN)
            down = [(x[:, None] * FAN + ways) if k + 1 < len(t.levels) else x[:, None] for x, t in ((i, a), (j, b))]
            i, j = (x.reshape(-1) for x in np.broadcast_arrays(down[0][:, :, None], down[1][:, None, :]))
            inside = (i < len(a.level(k)[1])) & (j < len(b.level(k)[1]))
            if same:
                inside &= (i <= j) if k else (i < j)
            i, j = i[inside], j[inside]
        elif same and not k:
            return i[:0], j[:0]
        ok = [possible(a.level(k), i[x : x + PAIRS], b.level(k), j[x : x + PAIRS], num, den) for x in range(0, len(i), PAIRS)]
        ok = np.concatenate(ok) if ok else np.empty(0, bool)
        i, j = i[ok], j[ok]
    return i, j


def links(left: list, right: list | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what links among (node, set) of left, or between left and right, connect; right None: among
    left. Pairs that are connected already aren't compared."""
    left = sorted(left, key=lambda x: (len(x[1]), x[0]))
    right = left if right is None else sorted(right, key=lambda x: (len(x[1]), x[0]))
    a = SignatureTree([s for _, s in left])
    b = a if right is left else SignatureTree([s for _, s in right])
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in candidates(a, b, num, den)), strict=True):
        (u, s), (v, t) = left[i], right[j]
        if (p := find(u)) == (q := find(v)):
            continue
        both = len(np.intersect1d(s, t, assume_unique=True))
        if both * den >= num * (len(s) + len(t) - both):
            top[p] = q
            out.append((u, v))
    return out


@tidy
def _traverse(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (pair, side, node, s) in order of pair: the links of each pair of blocks. side 0 alone: a block with itself."""
    held, now = ([], []), None

    def done() -> pa.RecordBatch:
        found = links(held[0], held[1] or None, num, den) if len(held[0]) + len(held[1]) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for pair, side, node, s in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "node", "s")), strict=True):
            if pair != now:
                if now is not None:
                    yield done()
                held, now = ([], []), pair
            held[side].append((node, np.frombuffer(s, np.uint64)))
    if now is not None:
        yield done()


@tidy
def _traverse_texts(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, node, text) in order of block, to the links within each block. Sets are made here, where a text is
    smaller than its set."""
    memo = WordHashes()

    def with_sets() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width, memo).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("node"), pa.array(sets, pa.binary())], names=["pair", "side", "node", "s"])

    return _traverse(with_sets(), num, den)


def _block_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, s) in order of block: the root of each block's tree."""
    names = ["block", "lo", "hi", "ones", "over", "bits"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.binary()]
    now, acc = None, None

    def root() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([now, *acc[:4], acc[4].tobytes()], kinds, strict=True)], names=names)

    for batch in batches:
        for block, s in zip(batch.column("block").to_pylist(), batch.column("s").to_pylist(), strict=True):
            bits, lo, hi, ones, over = SignatureTree([np.frombuffer(s, np.uint64)]).levels[0]
            one = [int(lo[0]), int(hi[0]), int(ones[0]), int(over[0]), bits[0]]
            if block != now:
                if now is not None:
                    yield root()
                now, acc = block, one
            else:
                acc = [min(acc[0], one[0]), max(acc[1], one[1]), min(acc[2], one[2]), max(acc[3], one[3]), acc[4] | one[4]]
    if now is not None:
        yield root()


def _prune(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for k in ("a", "b"):
            bits = np.array([np.frombuffer(x, np.uint64) for x in batch.column(f"bits_{k}").to_pylist()]).reshape(-1, BITS // 64)
            sides.append((bits, *(batch.column(f"{c}_{k}").to_numpy() for c in ("lo", "hi", "ones", "over"))))
        at = np.arange(batch.num_rows)
        ok = possible(sides[0], at, sides[1], at, num, den) if len(at) else np.empty(0, bool)
        yield batch.select(["block_a", "block_b"]).filter(pa.array(ok))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", rare_first: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, rk (hash of id and text), n_shingles, component_id.

    Two documents link when den * intersection >= num * union of their shingle sets. component_id is the smallest id
    reachable by links, itself included. A text that is null or has no words has an empty set, links with nothing and
    is its own component, as is its id null. rare_first says how nodes are dealt to trees, which changes no result: by
    rare shingles, better for long shingles and low thresholds; else by parts, better where few shingles may differ. Null ids are never the smallest unless all are null; repeated rows are
    equal sets and so linked; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).cast("string").alias("text"))
    rare = rarity(rows, width) if rare_first else None
    per = staged(rows.mapInArrow(partial(_profile, width=width, num=num, den=den, rare=rare), "doc_id long, rk long, n long, node long, keys array<long>"), "join-profiles")
    nodes = staged(per.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.any_value("n").alias("n")), "join-nodes")

    wanted = staged(nodes.select("node", "rk", "n").join(_trees(per.select("node", "keys")), "node"), "join-wanted")

    def texts_of(some: DataFrame) -> DataFrame:
        """The texts of some nodes; only those texts shuffle. A repeated row's set comes twice."""
        blocks = bloom.blocks_for(some.count())
        near = bloom.probe(rows, "rk", staged(bloom.member_filter(some, "rk", blocks), "join-bloom"), blocks, "maybe").where("maybe")
        return near.select("rk", "text").join(some, "rk").drop("rk")

    # Large clusters are dealt anew: among their own nodes, fewer hold a shingle, and rare ones tell more.
    for _ in range(ROUNDS):
        crowded = staged(wanted.where(F.col("size") > BLOCK).select("rk", "node", "n"), "join-crowded")
        before = crowded.count()
        if not before:
            break
        texts = staged(texts_of(crowded), "join-crowded-texts")
        rare = rarity(texts, width)
        trees = _trees(texts.mapInArrow(partial(_prefixes, width=width, num=num, den=den, rare=rare), "node long, keys array<long>"))
        wanted = staged(wanted.where(F.col("size") <= BLOCK).unionByName(crowded.join(trees, "node").select(*wanted.columns)), "join-wanted")
        if wanted.where(F.col("size") > BLOCK).count() > 0.9 * before:
            break

    # A cluster of up to BLOCK nodes is one block.
    alone = wanted.where(F.col("size") <= BLOCK).select("rk", "node", F.col("cluster").alias("block"))
    inner = texts_of(alone).repartition("block").sortWithinPartitions("block").mapInArrow(partial(_traverse_texts, width=width, num=num, den=den), "a long, b long")

    # Cluster, band of sizes, block: bands of a ratio of den / num, so similar sets are in one band or in neighbours.
    band = F.floor(F.log("n") / math.log(den / num)).cast("long") if den > num else F.col("n")
    large = wanted.where(F.col("size") > BLOCK).withColumn("band", band)
    filled = F.greatest(F.count(F.lit(1)) / LARGE_BLOCK, F.sum("n") / BLOCK_SHINGLES)
    count = large.groupBy("cluster", "band").agg(F.ceil(filled).cast("long").alias("n_blocks"))
    block = F.concat_ws(":", "cluster", "band", F.pmod(F.xxhash64("node"), "n_blocks"))
    large = staged(large.join(count, ["cluster", "band"]).select("rk", "node", "cluster", "band", block.alias("block")), "join-large")
    placed = staged(texts_of(large).mapInArrow(partial(_sets, width=width), "cluster long, band long, block string, node long, s binary"), "join-sets")
    roots = placed.select("block", "s").repartition("block").sortWithinPartitions("block").mapInArrow(_block_bits, "block string, lo long, hi long, ones long, over long, bits binary")
    roots = staged(roots.withColumn("cluster", F.split("block", ":")[0].cast("long")).withColumn("band", F.split("block", ":")[1].cast("long")), "join-roots")
    side = lambda k: roots.select("cluster", "band", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi", "ones", "over", "bits")))
    higher = side("b").withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("step"))
    met = side("a").join(higher, ["cluster", "band"]).where("step = 1 or block_a <= block_b")
    met = met.mapInArrow(partial(_prune, num=num, den=den), "block_a string, block_b string")
    met = staged(met.withColumn("pair", F.xxhash64("block_a", "block_b")), "join-pairs")
    ends = met.select("pair", F.col("block_a").alias("block"), F.lit(0).alias("side")).unionByName(met.where("block_a <> block_b").select("pair", F.col("block_b").alias("block"), F.lit(1).alias("side")))
    found = ends.join(placed.select("block", "node", "s"), "block").select("pair", "side", "node", "s").repartition("pair").sortWithinPartitions("pair", "side")
    linked = connected_components(inner.unionByName(found.mapInArrow(partial(_traverse, num=num, den=den), "a long, b long")))

    named = nodes.select("node", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(named.join(least, "root").select("node", "component_id"), "join-named")
    out = per.join(named, "node", "left")
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id stays, with all columns;
    rows that repeat its id and text count as one. Documents without words stay."""
    per = components(docs, width, num, den, id_col, text_col, rare_first=True)
    rk, maybe = fresh(docs, "__rk"), fresh(docs, "__maybe")
    gone = per.where("n_shingles > 0 and not (doc_id <=> component_id)").select(F.col("rk").alias(rk)).distinct()
    gone = staged(gone, "join-gone")
    blocks = bloom.blocks_for(gone.count())
    rows = bloom.probe(docs.withColumn(rk, row_key(id_col, text_col)), rk, staged(bloom.member_filter(gone, rk, blocks), "join-gone-bloom"), blocks, maybe)
    sure = rows.where(~F.col(maybe)).drop(maybe)
    asked = rows.where(F.col(maybe)).drop(maybe).join(gone, rk, "left_anti")
    return sure.unionByName(asked).select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).drop("rk")
