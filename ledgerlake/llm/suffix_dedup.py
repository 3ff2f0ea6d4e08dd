"""Suffix-array deduplication (operator 10): removes every byte of a WIDTH-byte string that also starts elsewhere.

Equal strings of SPAN bytes have the same least hash of GRAM bytes at the same offset, so both meet at that anchor. Anchors
whose whole surroundings are equal, by a cryptographic digest, are settled by counting. The others of an anchor form a
bucket, in which what follows the anchor is sorted, and so is what precedes it, backwards: a merge sort whose comparisons
find the common extension by binary search over prefix polynomial hashes, so a comparison is logarithmic. Neighbours in
the order are verified byte by byte. Strings around the anchor are equal when both their halves are.

No bucket is sorted with more than BUCKET surroundings. A larger one is split by offset before the anchor: surroundings
meet again, a range of offsets at a time, only where all strings that start in the range have a common core. What still
is too large is split on, down to single strings, which are equal when their digests are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bloom
from ledgerlake.llm.common import bounded_batches, lookup, staged, table

#: Bytes of a string that is removed, and of a passage that is reported; window and bytes of an anchor.
WIDTH, PASSAGE, SPAN, GRAM = 400, 240, 352, 64
#: Surroundings that are sorted together at most, parts into which a range of offsets is split, at first and later.
BUCKET, FIRST_WAYS, WAYS = 1024, 2, 4
#: Bytes that are hashed at once; surroundings that a task sorts in one go; offsets that it looks at together.
BLOCK, ROWS, COLUMNS = 1 << 20, 3072, 48
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=11) for b in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out, width = np.ones(n, np.uint64), 1
    while width < n:
        out[width : 2 * width] = out[: min(width, n - width)] * np.uint64(pow(base, width, 1 << 64))
        width *= 2
    return out


POWERS = _powers(BASE, BLOCK + 1024)
INVERSE = _powers(pow(BASE, -1, 1 << 64), BLOCK + 1024)


def _sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each ``width`` neighbours, in time that doesn't depend on the width."""
    rows = -(-len(x) // width)
    padded = np.full(rows * width, fill, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    before = op.accumulate(grid, axis=1).reshape(-1)
    after = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return op(after[:n], before[width - 1 : width - 1 + n])


def anchors(raw: bytes, width: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each GRAM that has the least hash of some ``width`` bytes around it; of a shorter text, of
    that with the least hash of all."""
    found, hashes = [], []
    width = min(width, len(raw))
    span = width - GRAM + 1
    for k in range(0, len(raw) - width + 1 if span > 0 else 0, BLOCK):
        seg = np.frombuffer(raw, np.uint8)[k : k + BLOCK + width - 1]
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(BYTES[seg] * POWERS[: len(seg)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * INVERSE[: len(seg) - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        least = _sliding(h, span, np.minimum, MASK)
        edge = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum, 0) == h)
        found.append(at + k)
        hashes.append(h[at])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def surroundings(raw: bytes | memoryview, pos: int, width: int = WIDTH) -> tuple[int, bytes]:
    """The anchor's offset in them, and all bytes of the strings of ``width`` bytes that hold the anchor."""
    start = max(0, pos - (width - GRAM))
    return pos - start, bytes(raw[start : pos + width])


def digest(offset: int, raw: bytes) -> bytes:
    """16 bytes that tell strings at an offset apart: half of a cryptographic digest."""
    return hashlib.sha256(b"%d:%b" % (offset, raw)).digest()[:16]


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))


PROFILE = "k1 long, k2 long, rk long, n long, pos array<int>, h array<long>, c1 array<long>, c2 array<long>"


def _profile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, pos, hashes, contexts = [], [], [], []
        for raw in batch.column("text").cast(pa.binary()).to_pylist():
            at, h = anchors(raw)
            n.append(len(at))
            pos.append(at.astype(np.int32))
            hashes.append(h.view(np.int64))
            contexts += [digest(*surroundings(raw, p, width)) for p in at.tolist()]
        edges = pa.array(np.cumsum([0, *n]), pa.int32())
        lists = [pa.array(np.concatenate([np.empty(0, np.int32), *pos])), pa.array(np.concatenate([np.empty(0, np.int64), *hashes])), *_halves(contexts)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "rk", "n")), *(pa.ListArray.from_arrays(edges, x) for x in lists)], names=["k1", "k2", "rk", "n", "pos", "h", "c1", "c2"])


AROUND = "k1 long, k2 long, pos int, h long, c1 long, many boolean, a int, around binary"


def _contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text, wanted) to the surroundings of the wanted anchors."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    for batch in batches:
        for k1, k2, raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            for k in range(0, len(wanted), 4096):
                rows = [(k1, k2, w["pos"], w["h"], w["c1"], w["many"], *surroundings(raw, w["pos"], width)) for w in wanted[k : k + 4096]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k1", "k2", "pos", "h", "c1", "many", "a", "around"])


class Suffixes:
    """Strings in groups (equal neighbours of ``group``), sorted within their group.

    order: the strings in order. agree: how many bytes each in this order shares with the one before, -1 for the first of
    a group.
    """

    def __init__(self, strings: list[bytes], group: np.ndarray):
        n = len(strings)
        self.lens = np.fromiter(map(len, strings), np.int64, n)
        self.wide = int(self.lens.max(initial=0)) + 1
        flat = np.frombuffer(b"".join(s.ljust(self.wide, b"\0") for s in strings), np.uint8)
        self.bytes = flat.reshape(n, self.wide)
        hashes = np.zeros((n, self.wide + 1), np.uint64)
        np.cumsum(BYTES[self.bytes] * POWERS[: self.wide], axis=1, out=hashes[:, 1:])
        self.hashes = hashes.reshape(-1)
        first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.empty(0, bool)
        self.start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.empty(0, np.int64)
        self.size = np.bincount(self.start, minlength=n)[self.start] if n else np.empty(0, np.int64)
        self.first = first
        self.order = self._merge_sort()
        self.agree = np.full(n, -1, np.int64)
        inner = np.flatnonzero(~first)
        self.agree[inner] = self._common(self.order[inner - 1], self.order[inner])
        self._verify(strings, inner)

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the common prefix, by binary search for the longest prefixes with equal hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.lens[i], self.lens[j])
        at_i, at_j = i * (self.wide + 1), j * (self.wide + 1)
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.hashes[at_i + mid] == self.hashes[at_j + mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return np.minimum(lo, hi)

    def _after(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte at place n, -1 at the end."""
        return np.where(n < self.lens[i], self.bytes[i, np.minimum(n, self.wide - 1)].astype(np.int64), -1)

    def _merge_sort(self) -> np.ndarray:
        """Runs of 1, 2, 4, ... are merged two by two, in all groups at once: each string's place is its rank in its own
        run and in the other one, found by binary search."""
        order, width = np.arange(len(self.lens)), 1
        at = order - self.start
        while len(on := np.flatnonzero(self.size > width)):
            x, begin, size, r = order[on], self.start[on], self.size[on], at[on]
            run = r // width
            lo = np.minimum((run ^ 1) * width, size)
            other, hi = lo.copy(), np.minimum(lo + width, size)
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(lo < hi)
                mid = (lo[open_] + hi[open_]) >> 1
                y, own = order[begin[open_] + mid], x[open_]
                n = self._common(y, own)
                a, b = self._after(y, n), self._after(own, n)
                before = (a < b) | ((a == b) & (run[open_] % 2 == 1))
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            merged = order.copy()
            merged[begin + (run & ~1) * width + r % width + lo - other] = x
            order, width = merged, width * 2
        return order

    def _verify(self, strings: list[bytes], inner: np.ndarray) -> None:
        """Compares neighbours byte by byte. Groups in which prefixes with equal hashes differ are sorted by bytes."""
        wrong: set[int] = set()
        for k in range(0, len(inner), 1024):
            some = inner[k : k + 1024]
            i, j = self.order[some - 1], self.order[some]
            differ = self.bytes[i] != self.bytes[j]
            true = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), self.wide), np.minimum(self.lens[i], self.lens[j]))
            bad = (true != self.agree[some]) | (self._after(i, true) > self._after(j, true))
            wrong.update(self.start[some[bad]].tolist())
        for s in wrong:
            e = s + int(self.size[s])
            own = sorted(range(s, e), key=strings.__getitem__)
            self.order[s:e] = own
            for k in range(s + 1, e):
                a, b = strings[own[k - s - 1]], strings[own[k - s]]
                n = min(len(a), len(b))
                self.agree[k] = next((x for x in range(n) if a[x] != b[x]), n)

    def longest(self) -> np.ndarray:
        """Of each string, the most bytes that it shares with another one of its group."""
        out = np.empty(len(self.agree), np.int64)
        out[self.order] = np.maximum(self.agree, np.append(self.agree[1:], -1))
        return np.maximum(out, 0)

    def only(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, agree, lens) of some strings, one at least, numbered as in ``some``."""
        number = np.full(len(self.order), -1, np.int64)
        number[some] = np.arange(len(some))
        kept = np.flatnonzero(number[self.order] >= 0)
        agree = np.minimum.reduceat(self.agree[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
        return number[self.order[kept]], agree, self.lens[some]


def classes(order: np.ndarray, agree: np.ndarray, lens: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """String by depth: equal numbers for strings of a group that share so many bytes; -1 for shorter strings."""
    rank = np.arange(len(order), dtype=np.int64)[:, None]
    ids = np.empty((len(order), len(depths)), np.int64)
    ids[order] = np.maximum.accumulate(np.where(agree[:, None] < depths[None, :], rank, 0), axis=0)
    ids[lens[:, None] < depths[None, :]] = -1
    return ids


def repeated_strings(back: Suffixes, ahead: Suffixes, width: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (surroundings, from, to) of bytes before the anchor at which strings of ``width`` bytes start that occur in
    two of a group; from lo to hi. Some columns at a time, so that memory is that of the surroundings."""
    before_most, ahead_most = back.longest(), ahead.longest()
    some = np.flatnonzero(before_most + ahead_most >= width)
    if not len(some):
        return some, some, some
    first = max(0, width - int(ahead_most[some].max()), int(lo[some].min()))
    last = min(width - GRAM, int(before_most[some].max()), int(hi[some].max()))
    # Offsets at which a string of each can have a like at all.
    least = np.maximum(lo[some], width - ahead_most[some])
    most = np.minimum(hi[some], before_most[some])
    n = len(some)
    out = np.zeros((n, max(0, last - first + 1) + 2), np.int8)  # an empty column at both ends
    for k in range(first, last + 1, COLUMNS):
        before = np.arange(k, min(k + COLUMNS, last + 1))
        own = np.flatnonzero((least <= before[-1]) & (most >= k) & (least <= most))
        if len(own) < 2:
            continue
        at = some[own]
        b, f = classes(*back.only(at), before), classes(*ahead.only(at), width - before)
        inside = (b >= 0) & (f >= 0) & (before >= least[own, None]) & (before <= most[own, None])
        both = np.ascontiguousarray(np.where(inside, b * len(own) + f, -1 - np.arange(len(own))[:, None]).T)
        order = np.argsort(both, axis=1)
        ranked = np.take_along_axis(both, order, axis=1)
        same = ranked[:, 1:] == ranked[:, :-1]
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        marks = np.empty(both.shape, np.int8)
        np.put_along_axis(marks, order, twice.view(np.int8), axis=1)
        out[own, 1 + k - first : 1 + k - first + len(before)] = marks.T
    edge = np.diff(out, axis=1)
    (i, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return some[i], begin + first, end + first - 1


#: width: that of the strings which cover the bytes, the largest one wanted or a smaller one.
COVER = {"k1": pa.int64(), "k2": pa.int64(), "width": pa.int32(), "lo": pa.int64(), "hi": pa.int64()}
DIGESTS = {"id": pa.int64(), "width": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "g": pa.int64(), "f1": pa.int64(), "f2": pa.int64()}


def _rows(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))


def _ddl(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in columns.items())


def _buckets(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Surroundings in order of group, with the offsets (lo to hi) and the width (0: all of ``widths``) that count: the
    bytes that repeated strings cover. Whole groups are sorted together, ROWS and one group at most."""
    held: list[tuple] = []
    begins = 0

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        group = np.array([r[0] for r in rows], np.int64)
        back = Suffixes([r[7][: r[6]][::-1] for r in rows], group)
        ahead = Suffixes([r[7][r[6] :] for r in rows], group)
        lo, hi = (np.array([r[k] for r in rows], np.int64) for k in (4, 5))
        own = np.array([r[8] for r in rows], np.int64)
        k1, k2, pos = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        for width in widths:
            i, begin, end = repeated_strings(back, ahead, width, lo, np.where((own == 0) | (own == width), hi, -1))
            if len(i):
                columns = (k1[i], k2[i], np.full(len(i), width, np.int32), pos[i] - end, pos[i] - begin + width)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, COVER.values(), strict=True)], names=list(COVER))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("g", "k1", "k2", "pos", "lo", "hi", "a", "around", "width")), strict=True):
            if held and row[0] != held[-1][0]:
                if begins == len(held) - 1:
                    held.pop()  # alone in its group
                if len(held) >= ROWS:
                    yield from done(held)
                    held = []
                begins = len(held)
            if len(held) == begins or row[1:4] != held[-1][1:4]:  # a text that several rows have comes several times
                held.append(row)
    if len(held) > 1:
        yield from done(held)


def _split(batches: Iterator[pa.RecordBatch], ways: int) -> Iterator[pa.RecordBatch]:
    """Of surroundings and each part of their ranges of offsets before the anchor: g, a hash of the anchor, the range and
    what all strings that start there share, and a digest of all their bytes. Where a text's edge cuts a range, nothing
    else has the latter. Parts whose g is equal by chance are sorted together, each by its own range."""
    for batch in batches:
        out = []
        for key, h, a, s, ranges in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "a", "around", "ranges")), strict=True):
            for width, begin, end in ((r["width"], r["lo"], r["hi"]) for r in ranges):
                least, most = max(0, a + width - len(s)), min(a, width - GRAM)
                step = -(-(end - begin + 1) // ways)
                for lo in range(begin, end + 1, step):
                    hi = min(lo + step - 1, end)
                    if hi < least or lo > most:
                        continue
                    core = b"%d:%d:%d:%d:%b" % (h, width, lo, hi, s[max(0, a - lo) : a - hi + width])
                    whole = s[a - hi : a - lo + width] if least <= lo and hi <= most else b"%d" % key
                    full = hashlib.sha256(b"%d:%d:%d:%d:%b" % (h, width, lo, hi, whole)).digest()
                    out.append((key, width, lo, hi, xxhash.xxh3_64_intdigest(core) - (1 << 63), int.from_bytes(full[:8], "little", signed=True), int.from_bytes(full[8:16], "little", signed=True)))
            if len(out) >= 65536:
                yield _rows(out, DIGESTS)
                out = []
        if out:
            yield _rows(out, DIGESTS)


def _split_large(around: DataFrame, widths: tuple[int, ...], bucket: int) -> DataFrame:
    """What _buckets finds, for buckets of any size.

    Ranges of offsets whose bytes are equal in two surroundings are repeated as a whole. Of the different ones that share
    a range's core, up to ``bucket`` are sorted; more are split on. Counts combine before they meet, so no bucket does.
    """
    full = ["g", "f1", "f2"]
    ranges = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(0).alias("lo"), F.lit(w - GRAM).alias("hi")) for w in widths))
    around = around.dropDuplicates(["h", "c1"]).select(F.monotonically_increasing_id().alias("id"), "h", "k1", "k2", "pos", "a", "around")
    around = staged(around, "suffix-crowded")
    todo, spans, few = around.withColumn("ranges", ranges), [], []
    while True:
        each = staged(todo.mapInArrow(partial(_split, ways=WAYS if few else FIRST_WAYS), _ddl(DIGESTS)), "suffix-ranges")
        fulls = staged(each.groupBy(*full).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "width", "lo", "hi")).alias("one")), "suffix-fulls")
        whole = staged(fulls.where("n > 1").select(*full, "n", F.lit(True).alias("whole")), "suffix-whole-ranges")
        spans.append(lookup(each, whole, full, "n").where("whole").select("id", "width", "lo", "hi"))
        shared = staged(fulls.groupBy("g").agg(F.count(F.lit(1)).alias("n_fulls")).where("n_fulls > 1").withColumn("size", F.col("n_fulls")), "suffix-shared")
        open_ = staged(lookup(fulls.select("g", "one.*"), shared, ["g"], "n_fulls").where("size is not null"), "suffix-open")
        few.append(open_.where(F.col("size") <= bucket).select("id", "width", "lo", "hi", "g"))
        more = open_.where((F.col("size") > bucket) & (F.col("hi") > F.col("lo")))
        if more.isEmpty():
            break
        more = more.groupBy("id").agg(F.collect_set(F.struct("width", "lo", "hi")).alias("ranges"))
        todo = around.join(more, "id")

    # All levels together meet their surroundings once, and their texts and places once.
    key = ["k1", "k2", "pos"]
    leaves = reduce(DataFrame.unionByName, few).join(around.select("id", *key, "a", "around"), "id").drop("id").repartition("g").sortWithinPartitions("g", *key)
    sure = reduce(DataFrame.unionByName, spans).join(around.select("id", *key), "id")
    sure = sure.select("k1", "k2", "width", (F.col("pos") - F.col("hi")).cast("long").alias("lo"), (F.col("pos") - F.col("lo") + F.col("width")).cast("long").alias("hi"))
    return sure.unionByName(leaves.mapInArrow(partial(_buckets, widths=widths), _ddl(COVER)))


SPANS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, passages array<struct<start:long,end:long>>, kept binary"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(found: list[dict]) -> list[dict]:
    merged: list[dict] = []
    for x in sorted(found, key=lambda x: x["start"]):
        if merged and x["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], x["end"])
        else:
            merged.append(dict(x))
    return merged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, passages, kept = [], [], []
        for raw, gone, seen in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("passages").to_pylist(), strict=True):
            merged, at, left = _merged(gone), 0, []
            for x in merged:
                left.append(raw[at : x["start"]])
                at = x["end"]
            spans.append(merged)
            passages.append(_merged([*seen, *merged]))
            kept.append(b"".join([*left, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(spans, SPAN_TYPE), pa.array(passages, SPAN_TYPE), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "passages", "kept"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket: int = BUCKET, passage: int = PASSAGE) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (removed bytes, maximal), passages, kept (the bytes outside spans).

    passages: bytes of strings of ``passage`` bytes that two texts, or two places, have around a common anchor; all such
    strings of SPAN bytes and more have one, shorter ones mostly. They are reported, not removed, unless in spans.
    Texts are UTF-8 bytes, null is empty; matches never cross documents. Texts shorter than ``width`` lose nothing, equal
    texts of that length and more lose everything, as do repeated rows. Other columns don't matter; no rows give no
    rows. Texts without a repeated string aren't shuffled. GRAM < passage <= SPAN <= width; ``bucket`` changes no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.xxhash64(F.col(id_col), text).alias("rk"))
    long_rows = rows.where(F.col("n") >= passage)
    per = staged(long_rows.mapInArrow(partial(_profile, width=width), PROFILE), "suffix-profiles")
    counts = per.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("rk").alias("first")).where("copies > 1")
    several = staged(counts, "suffix-copies")
    per = lookup(per, several, ["k1", "k2"], "copies").where("first is null or rk = first")
    at = per.select("k1", "k2", "rk", F.col("n").alias("n_bytes"), F.col("first").isNotNull().alias("copied"), F.explode(F.arrays_zip("pos", "h", "c1", "c2")).alias("x")).select("k1", "k2", "rk", "n_bytes", "x.*", "copied")

    # Equal surroundings, by anchor; anchors with several kinds of surroundings.
    kind = ["h", "c1", "c2"]
    kinds = staged(at.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "pos")).alias("one")), "suffix-kinds")
    mixed = staged(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n_kinds")).where("n_kinds > 1"), "suffix-mixed")
    whole = staged(kinds.where("n > 1").select(*kind, "n", F.lit(True).alias("whole")), "suffix-whole")
    blocks = bloom.blocks_for(whole.count())
    near = bloom.probe(at.where("not copied"), "c1", staged(bloom.member_filter(whole, "c1", blocks), "suffix-bloom"), blocks, "maybe").where("maybe").drop("maybe")
    covered = lookup(near, whole, kind, "n").where("whole")
    covered = covered.select("k1", "k2", F.greatest(F.col("pos") - (width - GRAM), F.lit(0)).cast("long").alias("lo"), F.least(F.col("pos") + width, F.col("n_bytes")).cast("long").alias("hi"))
    covered = covered.withColumn("width", F.when(F.col("hi") - F.col("lo") >= width, width).otherwise(passage)).where(F.col("hi") - F.col("lo") >= passage)

    # One of each kind of surroundings of a mixed anchor, with its bytes.
    blocks = bloom.blocks_for(mixed.count())
    near = bloom.probe(kinds, "h", staged(bloom.member_filter(mixed, "h", blocks), "suffix-mixed-bloom"), blocks, "maybe").where("maybe")
    near = lookup(near.select("h", "c1", "one"), mixed.withColumn("size", F.col("n_kinds")), ["h"], "n_kinds").where("size is not null")
    wanted = near.select("one.rk", F.struct("one.pos", "h", "c1", (F.col("size") > bucket).alias("many")).alias("w"))
    wanted = staged(wanted.groupBy("rk").agg(F.collect_list("w").alias("wanted")), "suffix-wanted")
    blocks = bloom.blocks_for(wanted.count())
    asked = bloom.probe(long_rows, "rk", staged(bloom.member_filter(wanted, "rk", blocks), "suffix-wanted-bloom"), blocks, "maybe").where("maybe").select("k1", "k2", "rk", "text")
    around = staged(asked.join(wanted, "rk").mapInArrow(partial(_contexts, width=width), AROUND), "suffix-around")
    few = around.where("not many").select(F.col("h").alias("g"), "k1", "k2", "pos", F.lit(0).alias("width"), F.lit(0).alias("lo"), F.lit(width).alias("hi"), "a", "around")
    edges = few.repartition("g").sortWithinPartitions("g", "k1", "k2", "pos").mapInArrow(partial(_buckets, widths=(width, passage)), _ddl(COVER))
    many = around.where("many")
    if not many.isEmpty():
        edges = edges.unionByName(_split_large(many, (width, passage), bucket))

    span = F.struct(F.col("lo").alias("start"), F.col("hi").alias("end"))
    wide = F.col("width") >= width
    marks = covered.select(*COVER).unionByName(edges).groupBy("k1", "k2").agg(F.collect_set(F.when(wide, span)).alias("spans"), F.collect_set(F.when(~wide, span)).alias("passages"))
    marks = staged(marks.join(several.select("k1", "k2"), ["k1", "k2"], "left_anti"), "suffix-marks")
    known = staged(several.select("k1").unionByName(marks.select("k1")), "suffix-known")
    blocks = bloom.blocks_for(known.count())
    asked = bloom.probe(rows, "k1", staged(bloom.member_filter(known, "k1", blocks), "suffix-known-bloom"), blocks, "maybe")
    none = F.array().cast("array<struct<start:long,end:long>>")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    clean = asked.where("not maybe").select("doc_id", F.col("n").alias("n_bytes"), none.alias("spans"), none.alias("passages"), F.col("text").cast("binary").alias("kept"))
    met = lookup(asked.where("maybe").drop("maybe", "rk"), several, ["k1", "k2"], "copies")
    long_enough = F.col("n") >= width
    copies = met.where("first is not null").select("doc_id", F.col("n").alias("n_bytes"), F.when(long_enough, all_of).otherwise(none).alias("spans"), all_of.alias("passages"), F.when(long_enough, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"))
    rest = met.where("first is null").drop("first").join(marks, ["k1", "k2"], "left").withColumns({"spans": F.coalesce("spans", none), "passages": F.coalesce("passages", none)})
    return clean.unionByName(copies).unionByName(rest.select("doc_id", "n", "text", "spans", "passages").mapInArrow(_cut, SPANS))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_repeated, beside the contract's columns: bytes in passages, as deduplicate() reports them."""
    out = deduplicate(table(spark, sf_dir, "documents"))
    length = lambda c: F.aggregate(F.transform(c, lambda x: x["end"] - x["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_bytes", length("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), length("passages").alias("n_repeated"))
