"""Periodic runs of words by a suffix automaton with merged end positions (operator 11).

The states of the automaton of a sequence stand for its substrings by the places where they end. From the longest states
to the shorter ones the sets of end positions are merged, the smaller into the larger, and each new pair of neighbours at a
distance of at most the state's length is a square: the state's string follows itself at that distance. The rightmost
square of a repetition spans it, so that the squares that nothing extends are the runs.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_batches, table, tidy

#: Words of a run at least and periods that it holds at least; words of texts that are looked at together; words of the
#: groups whose repetition is counted before the automaton; places of a block of an ordered set.
LEAST_WORDS, LEAST_PERIODS, TOGETHER, GRAM, BLOCK = 6, 4, 1 << 20, 3, 512


class Ordered:
    """An ordered set of whole numbers in blocks."""

    def __init__(self, x: int):
        self.blocks, self.lasts, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Takes x, which isn't there, and returns its neighbours."""
        k = min(bisect_left(self.lasts, x), len(self.blocks) - 1)
        block = self.blocks[k]
        i = bisect_left(block, x)
        block.insert(i, x)
        self.size += 1
        before = block[i - 1] if i else self.lasts[k - 1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        self.lasts[k] = block[-1]
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = block[:BLOCK], block[BLOCK:]
            self.lasts[k : k + 1] = block[BLOCK - 1], block[-1]
        return before, after


def automaton(s: list[int]) -> tuple[array, array, array]:
    """Of each state of the suffix automaton of s: the length of its longest string, its suffix link, and the place where
    it was made, or -1 for a copy. A state's first transition is in arrays, further ones are in a dictionary."""
    length, link, at, letter, to = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [-1])
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(s):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        at.append(i)
        letter.append(-1)
        to.append(-1)
        p = last
        while p >= 0:
            if letter[p] == c:
                q = to[p]
                break
            if letter[p] < 0:
                letter[p], to[p] = c, new
            elif p not in more:
                more[p] = {c: new}
            elif c in more[p]:
                q = more[p][c]
                break
            else:
                more[p][c] = new
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                at.append(-1)
                letter.append(letter[q])
                to.append(to[q])
                if q in more:
                    more[copy] = dict(more[q])
                link[q] = link[new] = copy
                while p >= 0:
                    if letter[p] == c and to[p] == q:
                        to[p] = copy
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
        last = new
    return length, link, at


def runs(s: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of s with at least so many letters and periods, of which two or more, by start,
    then period.

    A run of length n with period q ends at j; the string of length n - q before j also ends at j - q and nowhere between,
    or the period would be smaller. The two places become neighbours in the state whose longest string that is.
    """
    length, link, at = automaton(s)
    n, ends, found = len(s), {}, {}
    for v in np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist():
        own = ends.pop(v, None)
        if at[v] >= 0:
            if own is None:
                own = Ordered(at[v])
            else:
                own = met(s, own, Ordered(at[v]), length[v], periods, n, found)
        p = link[v]
        if own and p > 0 and length[p] >= periods - 1:
            ends[p] = met(s, ends[p], own, length[p], periods, n, found) if p in ends else own
    return sorted((a, b - a + 1, q) for (a, b), q in found.items() if b - a + 1 >= max(least, periods * q))


def met(s: list[int], one: Ordered, other: Ordered, size: int, periods: int, n: int, found: dict[tuple[int, int], int]) -> Ordered:
    """The union of the end positions of strings of a length; found gets the squares of new neighbours that nothing extends
    with their least period, but those of too few periods."""
    if one.size < other.size:
        one, other = other, one
    for x in other:
        before, after = one.add(x)
        for i, j in ((before, x), (x, after)):
            if i is not None and j is not None and (q := j - i) * (periods - 1) <= size and (j + 1 == n or s[i + 1] != s[j + 1]):
                start = i - size + 1
                if start == 0 or s[start - 1] != s[start - 1 + q]:
                    found[start, j] = min(q, found.get((start, j), q))
    return one


def stretches(keys: np.ndarray, text: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """Where runs may be: stretches (start, end) of words of a text, given a number for each word, equal for equal words,
    and its text. Every group of GRAM words of a run occurs in it some times, so words between groups that occur less
    often within their stretch are borders, again and again as long as that halves what is left. Groups are counted by
    hash: a collision only makes a stretch longer."""
    need = min([periods - 1, *((max(least, periods * q) - GRAM + 1) // q for q in range(1, GRAM - 1))])
    n = len(keys) - GRAM + 1
    if n <= 0:
        return []
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.uint64)
        for k in range(GRAM):
            gram = (gram ^ keys[k : k + n].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
        place, part, left = np.flatnonzero(text[:n] == text[GRAM - 1 :]), None, None
        while len(place) and (left is None or 2 * len(place) <= left):
            left = len(place)
            part = np.cumsum(np.append(True, (place[1:] != place[:-1] + 1) | (text[place[1:]] != text[place[:-1]]))).astype(np.uint64)
            bits = max(8, len(place).bit_length() + 2)
            bucket = ((gram[place] + part * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
            place = place[np.bincount(bucket, minlength=1 << bits)[bucket] >= need]
            begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (text[place[1:]] != text[place[:-1]])))[: len(place)]
            sizes = np.diff(np.append(begins, len(place)))
            place = place[np.repeat(sizes + GRAM - 1 >= least, sizes)]
    begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (text[place[1:]] != text[place[:-1]])))[: len(place)]
    return [(int(place[b]), int(place[e - 1]) + GRAM) for b, e in zip(begins, np.append(begins[1:], len(place)))]  # noqa: B905


def words_of(key: int | None, text: bytes) -> list[bytes]:
    return text.split()


#: One text as it is found: key, words, runs.
Found = tuple[int | None, list[bytes], list[tuple[int, int, int]]]


def found(texts: Iterator[tuple[int | None, bytes]], least: int, periods: int, words: Callable[[int | None, bytes], list[bytes]]) -> Iterator[Found]:
    held, n = [], 0

    def together() -> Iterator[Found]:
        sizes = [len(w) for _, w in held]
        keys = np.fromiter((hash(x) for _, w in held for x in w), np.int64, sum(sizes))
        ends, spans = np.cumsum(sizes), [[] for _ in held]
        for a, b in stretches(keys, np.repeat(np.arange(len(held)), sizes), least, periods):
            k = int(np.searchsorted(ends, a, side="right"))
            base = int(ends[k]) - sizes[k]
            ids: dict[bytes, int] = {}
            s = [ids.setdefault(x, len(ids)) for x in held[k][1][a - base : b - base]]
            spans[k] += [(a - base + start, size, q) for start, size, q in runs(s, least, periods)]
        for (key, w), r in zip(held, spans, strict=True):
            yield key, w, r

    for key, text in texts:
        w = words(key, text)
        held.append((key, w))
        n += len(w)
        if n >= TOGETHER:
            yield from together()
            held, n = [], 0
    yield from together()


@tidy
def _find(batches: Iterator[pa.RecordBatch], least: int, periods: int, words: Callable[[int | None, bytes], list[bytes]]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = zip(batch.column("doc_id").to_pylist(), (x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()), strict=True)
        keys, sizes, spans, kept = [], [], [], []
        for key, w, r in found(texts, least, periods, words):
            keys.append(key)
            sizes.append(len(w))
            spans.append([{"start": a, "length": n, "period": q} for a, n, q in r])
            if r:
                stays = np.ones(len(w) + 1, bool)
                for a, n, q in r:
                    stays[a + q : a + n] = False
                w = [x for x, stay in zip(w, stays) if stay]  # noqa: B905
            kept.append(b" ".join(w).decode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, words: Callable[[int | None, bytes], list[bytes]] = words_of) -> DataFrame:
    """RUNS of each whole text: its runs of at least so many words and periods, by start, then period, and its words without
    those that repeat a run's first period, joined by one space.

    Words are what stands between white space of ASCII, or what ``words`` makes of a row's id and text. One row per row of
    docs, without a shuffle; a null or empty text has no words; ids may be null or repeat; other columns don't matter; no
    rows give no rows. Equal stretches may overlap; each is a run of its own. A task's memory follows the longest text.
    """
    if periods < 2 or least < GRAM:
        raise ValueError(f"a run has two periods and {GRAM} words at least")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_find, least=least, periods=periods, words=words), RUNS)


def repeated_tail(key: int | None, text: bytes) -> list[bytes]:
    """The words of a text, of which a tenth, by id, repeat themselves from some word on. A null id changes nothing."""
    w = text.split()
    g, h = divmod(zlib.crc32(str(key).encode()), 10)
    if h or not w or key is None:
        return w
    a = g % len(w)
    n = len(w) - a
    p = 1 + n // (3 + g % 8)
    return w[:a] + (w[a : a + p] * -(-n // p))[:n]


def digests(found_runs: DataFrame) -> DataFrame:
    """The number of runs, the longest one (ties: smallest start, then period), and digests of runs and collapsed text."""
    r = F.col("runs")
    # The greatest struct: the longest run, then the smallest start, then the smallest period.
    best = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform(r, lambda x: F.concat(*(c for k in ("start", "length", "period") for c in (x[k].cast("string"), F.lit("," if k != "period" else "\n"))))), "")
    rows = found_runs.withColumn("best", best)

    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    start, size, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size(r).cast("long").alias("n_runs"), start.alias("start"), size.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(table(spark, sf_dir, "documents"), words=repeated_tail))
