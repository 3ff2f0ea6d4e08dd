"""Periodic runs against plain search; streaming BPE against the library."""

import hashlib
import random
import zlib

import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import periodic, stream_bpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs int, n_words string"


def plain_runs(s, least, periods):
    """Every period, every stretch that keeps it, and every smaller period of that stretch."""
    out = []
    for q in range(1, len(s) // periods + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            t = s[i : j + q]
            if len(t) >= max(least, periods * q) and not any(t[r:] == t[:-r] for r in range(1, q)):
                out.append((i, len(t), q))
            i = j + 1
    return sorted(out)


def plain_row(key, text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and w and key is not None:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w, 6, 4)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{n},{q}\n" for a, n, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *hashes)


def sequences(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        letters, s = rng.choice([1, 1, 2, 4]), []
        while len(s) < rng.randint(0, 60):
            s += [rng.randint(0, letters) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 4, 5, 9])
        yield s


@pytest.mark.parametrize("block", [1, 512])
def test_runs(monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    for s in sequences(block, 800):
        for least, periods in ((6, 4), (3, 2), (7, 3)):
            want = plain_runs(s, least, periods)
            assert periodic.runs(s, least, periods) == want
            text = b" ".join(b"w%d" % x for x in s)
            assert [r for _, _, r in periodic.found(iter([(1, text), (2, text), (3, b"")]), least, periods, periodic.words_of)] == [want, want, []]


def test_long_runs():
    assert periodic.runs([0] * 50000) == [(0, 50000, 1)]
    assert periodic.runs([0, 1, 2] * 20000 + [0, 0]) == [(0, 60001, 3)]


def test_periodic_rows(spark):
    rows = [(k, " ".join(f"w{x}" for x in s)) for k, s in enumerate(sequences(7, 150))]
    rows += [(None, "x " * 30), (None, None), (1, ""), (2, " \x0b\n\t "), (3, "a\x1cb a\x1cb\n" * 9), (3, "a\x1cb a\x1cb\n" * 9), (4, "é " * 7), (5, "long" * 50000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in periodic.digests(periodic.find(df, words=periodic.repeated_tail)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert periodic.digests(periodic.find(df.limit(0))).count() == 0
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, SF).collect()]
    assert sorted(got) == sorted(plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(stream_bpe.MODEL)


@pytest.fixture(scope="module")
def model():
    return stream_bpe.Model(stream_bpe.model_file(stream_bpe.MODEL))


def texts(seed, many):
    rng = random.Random(seed)
    letters = "ab'strevmld ÀéΣσİ人ſ1²½ͅ가ᅡᄀᆨ-!\x1c\x85　 \n_Ⰿ𝒜<|endoftext|>"
    for _ in range(many):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        yield t + rng.choice(["", "", "", "<|endoftext|>", "<|startoftext|>", "<|endoftext|", "a" * 300, "'s" * 30, "-" * 90 + "'re" + "b" * 100]) + t


@pytest.mark.parametrize("piece", [1, 3, 64, 1 << 16])
def test_stream(library, model, piece):
    for t in texts(piece, 400):
        want = library.encode(t, add_special_tokens=False).ids
        ids = [i for _, part in model.ids([t], piece) for i in part]
        assert ids == want
        told = stream_bpe.machine(model, False)
        assert "".join(told.feed(ids[k : k + 3]) for k in range(0, len(ids), 3)) + told.end() == library.decode(want, skip_special_tokens=False)


def test_lookahead(library, model):
    """Long words leave token by token, what is held is bounded, and the bound isn't met by luck: the list has chains."""
    rng = random.Random(5)
    assert 100 < model.lookahead < 2000
    for _ in range(60):
        word = "".join(rng.choice(["ortho", "pedic", "consi", "disintegr", "a", "e", "the", "qu"]) for _ in range(rng.randint(1, 2000)))
        t, got, held = stream_bpe.Transducer(model, 64), [], 0
        for k in range(0, len(word), 37):
            got += t.feed(word[k : k + 37].encode())
            held = max(held, len(t.held))
        assert [*got, *t.end()] == library.encode(word, add_special_tokens=False).ids
        assert held <= model.lookahead + 2 * 64
    assert stream_bpe.lookahead([("a", "b"), ("c", "ab"), ("d", "cab"), ("x", "y")], "</w>") == 3
    assert stream_bpe.lookahead([("a", "b"), ("c", "d")], "</w>") == 1


def test_forgetting(monkeypatch, library, model):
    monkeypatch.setattr(stream_bpe, "KNOWN", 3)
    monkeypatch.setattr(stream_bpe, "WORDS", 2)
    t = "one two three four two one five " + "z" * 80 + " six"
    assert [i for _, part in model.ids([t, t]) for i in part] == 2 * library.encode(t, add_special_tokens=False).ids


def test_stream_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "It's  ÉTÉ\x1c <|endoftext|> 12"), (3, "It's  ÉTÉ\x1c <|endoftext|> 12"), (None, "null id"), (4, "word " * 30000), (5, "a" * 70000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(2)
    for rows_df in (df, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in rows_df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))))
        encoded = stream_bpe.encode(rows_df)
        assert sorted(map(tuple, stream_bpe.digests(encoded).collect()), key=repr) == sorted(want, key=repr)
        decoded = [hashlib.sha256(r.text.encode()).hexdigest() for r in stream_bpe.decode(encoded).collect()]
        assert sorted(decoded) == sorted(w[-1] for w in want)
    plain = {r.doc_id: r.text for r in stream_bpe.decode(stream_bpe.encode(df), plain=True).collect()}
    assert plain[3] == "it 's été \x1c <|endoftext|>1 2 " and plain[1] == ""
    assert stream_bpe.digests(stream_bpe.encode(df.limit(0))).count() == 0


def test_other_models_are_errors():
    with pytest.raises(ValueError, match="another kind"):
        stream_bpe.Model(stream_bpe.model_file(stream_bpe.MODEL).replace(b'"Lowercase"', b'"Uppercase"'))
