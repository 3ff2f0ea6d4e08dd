"""Exact, near and substring deduplication against brute force, with nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from ledgerlake.llm import chunking, exact_dedup, ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, __sha string, maybe int"  # extra columns clash with names used inside
rng = random.Random(3)


def words(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


PASSAGE = words(120)
LONG = words(6000)
NEAR = words(300).split()
ROWS = [
    (1, "a  b\tc"), (2, "abc"), (3, "a b c d"), (4, None), (5, ""), (6, " \n"), (7, PASSAGE), (7, PASSAGE), (8, words(40) + " " + PASSAGE + " " + words(30)), (9, words(50) + " " + PASSAGE),
    (10, LONG), (11, LONG[:20000] + words(50)), (12, " ".join(NEAR)), (13, " ".join([*NEAR[:150], "changed", *NEAR[151:]])), (14, " ".join(NEAR).upper()), (15, "z" * 3000), (16, words(200)), (None, words(60)), (None, None), (17, "é" * 500 + PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def stripped(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact(docs, nothing):
    got = sorted(tuple(r) for r in exact_dedup.decisions(docs).select("text_sha256", "doc_id", "keep_id", "group_size", "kept").collect() if r.doc_id is not None)
    want = []
    for i, t in ROWS:
        same = [(j, u) for j, u in ROWS if stripped(u) == stripped(t)]
        best = max(same, key=lambda x: (len(x[1] or ""), x[0] is not None, -(x[0] or 0)))
        if i is not None:
            want.append((hashlib.sha256(stripped(t).encode()).hexdigest(), i, best[0], len(same), i == best[0] and len(t or "") == len(best[1] or "")))
    assert got == sorted(want)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({stripped(t) for _, t in ROWS})
    assert exact_dedup.decisions(nothing).count() == 0 and exact_dedup.deduplicate(nothing).count() == 0


def shingle_set(t, width):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize(("width", "num", "rare_first", "block"), [(3, 90, False, 256), (3, 90, True, 2), (5, 80, True, 256), (5, 80, True, 2)])
def test_near(monkeypatch, docs, nothing, width, num, rare_first, block):
    """Clusters above and below the size of a block."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = [shingle_set(t, width) for _, t in ROWS]
    top = list(range(len(ROWS)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(ROWS):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, _) in enumerate(ROWS))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.components(docs, width, num, 100, rare_first=rare_first).collect())
    assert got == want
    if width == 5:
        kept = ngram_join.one_each(docs)
        ids = {r.doc_id for r in kept.collect()}
        assert kept.columns == docs.columns and 12 in ids and not {13, 14} & ids and {4, 5, 6, 16} <= ids
        assert ngram_join.components(nothing).count() == 0


def test_only_shingles_of_several_rows_are_dealt(spark, monkeypatch):
    """A text that is like no other sends no key, so keys don't grow with the texts."""
    seen, staged = {}, ngram_join.staged

    def watched(df, name):
        seen[name] = staged(df, name)
        return seen[name]

    monkeypatch.setattr(ngram_join, "staged", watched)
    near = words(200)
    rows = [(k, words(200), "x", k) for k in range(60)] + [(60, near, "x", 60), (61, f"{near} more", "x", 61)]
    ngram_join.components(spark.createDataFrame(rows, SCHEMA), 5, 80, 100, rare_first=True)
    sent = {r.doc_id: r["size(keys)"] for r in seen["join-profiles"].selectExpr("doc_id", "size(keys)").collect()}
    assert sent[60] == 40 and sent[61] >= 39 and sum(sent[k] for k in range(60)) < 10


def test_shingles_are_counted_by_ranges(spark):
    """However rows are dealt and sent, a shingle is rare if one row has it, else as common as rows have it."""
    texts = [*(words(30) for _ in range(40)), *[PASSAGE] * 20, PASSAGE + " " + words(30), None, ""]
    levels = ngram_join.rarity(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), 5).unpacked()
    of = lambda t: levels.of(ngram_join.shingles(t.encode(), 5, ngram_join.WordHashes()))
    assert np.median(of(PASSAGE)) == 5 and of(PASSAGE).min() >= 5
    assert sum(np.count_nonzero(of(t)) for t in texts[:40]) < 10


@pytest.mark.parametrize("ranges", [8, 12])
def test_positions_come_back(monkeypatch, ranges):
    """What tasks send holds each position with its rows, in parts of any size."""
    monkeypatch.setattr(ngram_join, "HELD", 100)
    texts, got, want = [*ROWS, *ROWS], Counter(), Counter()
    for _, text in texts:
        want.update((ngram_join.shingles((text or "").encode(), 5, ngram_join.WordHashes()) >> np.uint64(64 - ngram_join.POSITION)).tolist())
    batch = pa.RecordBatch.from_arrays([pa.array([x for _, x in texts], pa.string())], names=["text"])
    for b in ngram_join._positions(iter([batch]), 5, ranges):
        for r in b.to_pylist():
            at, n = ngram_join.gaps_of(r["low"], r["high"])
            got.update(dict(zip((at + np.uint64(r["range"] << (ngram_join.POSITION - ranges))).tolist(), n.tolist(), strict=True)))
    assert got == want


def brute_masks(width):
    raw = [(t or "").encode() for _, t in ROWS]
    seen = {}
    for k, b in enumerate(raw):
        for s in range(len(b) - width + 1):
            seen.setdefault(b[s : s + width], []).append((k, s))
    masks = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                masks[k][s : s + width] = True
    return raw, masks


@pytest.mark.parametrize("bucket", [1024, 2])
def test_suffix(docs, nothing, bucket):
    """Removed bytes at any size of a bucket; passages have all strings of SPAN bytes and none shorter than asked."""
    got = suffix_dedup.deduplicate(docs, bucket=bucket).collect()
    raw, masks = brute_masks(400)
    want = sorted((str(i), len(b), int(m.sum()), bytes(np.frombuffer(b, np.uint8)[~m])) for (i, _), b, m in zip(ROWS, raw, masks, strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, sum(x.end - x.start for x in r.spans), bytes(r.kept)) for r in got) == want
    _, least = brute_masks(suffix_dedup.SPAN)
    _, most = brute_masks(suffix_dedup.PASSAGE)
    by_text = {(str(r.doc_id), r.n_bytes): r for r in got}
    for (i, _), b, lo, hi in zip(ROWS, raw, least, most, strict=True):
        found = np.zeros(len(b), bool)
        for x in by_text[str(i), len(b)].passages:
            found[x.start : x.end] = True
        assert not (lo & ~found).any() and not (found & ~hi).any()
    if bucket == 2:
        assert suffix_dedup.deduplicate(nothing).count() == 0


def test_crowded_bucket(spark):
    """200 texts share a passage of 450 bytes, each with an ending of its own, so that buckets split down to strings."""
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared = noise(450)
    texts = [noise(300) + shared + noise(300) for _ in range(200)] + [noise(900) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bucket in (1024, 8):
        got = {x.doc_id: x for x in suffix_dedup.deduplicate(df, bucket=bucket).collect()}
        spans = [[(x.start, x.end) for x in got[i].spans] for i in range(220)]
        assert all(len(x) == 1 and x[0][0] <= 300 and 750 <= x[0][1] <= 755 for x in spans[:200]) and not any(spans[200:])


def test_repeated_strings_looks_where_strings_can_repeat(monkeypatch):
    """Pairs that share WIDTH bytes at a few offsets only, by brute force; other offsets of theirs aren't looked at."""
    rng, width, gram = random.Random(5), 200, suffix_dedup.GRAM
    texts = []
    for k in range(60):
        near = k * 37 % (width - gram)
        shared = rng.randbytes(width + 3)
        texts += [(near + 100, rng.randbytes(100) + shared + rng.randbytes(100 - k)) for _ in range(2)]
    group = np.zeros(len(texts), np.int64)
    back, ahead = (suffix_dedup.Suffixes(x, group) for x in ([t[:a][::-1] for a, t in texts], [t[a:] for a, t in texts]))
    looked, true = [], suffix_dedup.classes
    monkeypatch.setattr(suffix_dedup, "classes", lambda *x: looked.append(len(x[0]) * len(x[3])) or true(*x))
    lo, hi = np.zeros(len(texts), np.int64), np.full(len(texts), width - gram)
    got = {(i, o) for i, b, e in zip(*suffix_dedup.repeated_strings(back, ahead, width, lo, hi), strict=True) for o in range(b, e + 1)}
    at = {}
    for i, (a, t) in enumerate(texts):
        for o in range(max(0, a + width - len(t)), min(a, width - gram) + 1):
            at.setdefault((o, t[a - o : a - o + width]), []).append(i)
    assert got == {(i, o) for (o, _), x in at.items() if len(x) > 1 for i in x} and got
    assert sum(looked) < len(texts) * (width - gram + 1)  # half of a look at all, for both sides


def test_suffix_sort():
    """Groups are sorted apart, in one go; agree is how far neighbours agree, also where hashes of prefixes collide."""
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    group = np.repeat([5, 3, 9, 4], [1, 120, 2, 77])
    for collide in (False, True):
        if collide:
            table, suffix_dedup.BYTES = suffix_dedup.BYTES, np.zeros(256, np.uint64)
        try:
            got = suffix_dedup.Suffixes(strings, group)
        finally:
            if collide:
                suffix_dedup.BYTES = table
        for begin, end in ((0, 1), (1, 121), (121, 123), (123, 200)):
            own = [strings[i] for i in got.order[begin:end]]
            assert own == sorted(strings[begin:end]) and got.agree[begin] == -1
            for k in range(begin + 1, end):
                a, b = own[k - begin - 1], own[k - begin]
                assert got.agree[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_chunks_resist_shifts():
    raw = LONG.encode()
    a, b = set(chunking.chunks(raw)[1]), set(chunking.chunks(b"inserted " + raw)[1])
    assert len(a & b) >= 0.99 * len(a)
    ends = chunking.boundaries(np.frombuffer(b"z" * 3000, np.uint8))
    assert ends[-1] == 3000 and np.diff(ends).max() <= chunking.MAX_BYTES


def test_chunk_dedup(docs, nothing):
    got = {r.doc_id: r for r in chunking.deduplicate(docs).collect() if r.doc_id is not None}
    text = {i: (t or "").encode() for i, t in ROWS if i is not None}
    for i, r in got.items():
        at, kept = 0, b""
        for x in r.spans:
            kept, at = kept + text[i][at : x.start], x.end
        assert kept + text[i][at:] == bytes(r.kept) and r.n_bytes == len(text[i])
    lost = {i: sum(x.end - x.start for x in r.spans) for i, r in got.items()}
    assert lost[7] == 0 and min(lost[8], lost[9], lost[17]) > 0.8 * len(PASSAGE) and lost[16] == 0 and lost[11] > 18000
    assert got[7].n_repeated > 0.8 * len(PASSAGE) and chunking.deduplicate(nothing).count() == 0
    assert isinstance(got[7], T.Row)


def test_short_passages_count(spark):
    """A passage of which one whole chunk of under 80 bytes is equal in both texts."""
    r = random.Random(8)
    noise = lambda n: bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    while len(texts) < 60:  # pairs
        shared = noise(100)
        pair = [noise(300) + shared + noise(300) for _ in range(2)]
        a, b = (set(chunking.chunks(x)[1]) for x in pair)
        if len(a & b) == 1:
            texts += pair
    got = chunking.deduplicate(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(got) == 60 and all(x.n_repeated > 0 and (len(x.spans) > 0) == (x.doc_id % 2 == 1) for x in got)


def brute_chunks(raw):
    """Byte by byte: the hash of the last 16 bytes, a boundary where its bits 10 to 14 are 0."""
    gear = chunking.GEAR.tolist()
    out, last = [], 0
    for at in range(1, len(raw) + 1):
        h = sum(gear[b] << k for k, b in enumerate(reversed(raw[max(0, at - 16) : at]))) % (1 << 64)
        met = at >= 16 and h >> 10 & 31 == 0 and at - last >= 16
        if met or at - last == 256 or at == len(raw):
            out.append((last, at))
            last = at
    return out


def test_chunk_query(spark, tmp_path):
    """Every row and column of op7_chunk_dedup against brute force; no oracle is the query itself."""
    from ledgerlake.llm import queries

    assert all(isinstance(x, str) for x in queries.ORACLE_SQL.values())
    rows = [(i, t) for i, t in dict(ROWS).items() if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    raw = {i: (t or "").encode() for i, t in sorted(rows)}
    places = {}
    for i, b in raw.items():
        for s, e in brute_chunks(b):
            places.setdefault(b[s:e], []).append((i, s, e))
    want = []
    for i, b in raw.items():
        own = brute_chunks(b)
        again = [(s, e) for s, e in own if len(places[b[s:e]]) > 1]
        gone = [(s, e) for s, e in again if places[b[s:e]][0][:2] != (i, s)]
        kept = b"".join(b[s:e] for s, e in own if (s, e) not in gone)
        n_spans = sum(s not in {e for _, e in gone} for s, _ in gone)
        ends = {}
        for s, e in again:  # runs by their end: neighbours become one
            ends[e] = ends.pop(s, s)
        passages = sum(e - s for e, s in ends.items() if e - s >= 80)
        want.append((i, len(b), len(own), sum(e - s for s, e in again), len(b) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), passages))
    assert sorted(tuple(r) for r in chunking.op7_chunk_dedup(spark, str(tmp_path)).collect()) == want
