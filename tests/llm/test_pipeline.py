"""Stages of the pipeline on the smallest tables: what each keeps, against brute force."""

import hashlib

import corpus_pipeline as P
import public_tokenizers

from ledgerlake.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def stripped(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        assert name == P.STAGES[-1][0] or docs.columns == columns
    good = seen["quality_classifier"]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    assert len(bad & {r.doc_id for r in good}) <= 0.2 * len(bad) and quality.TRAIN_ROWS == 8000
    exact = seen["exact_dedup"]
    assert {stripped(r.text) for r in exact} == {stripped(r.text) for r in good} and len({stripped(r.text) for r in exact}) == len(exact)
    near = seen["ngram_jaccard_join"]
    sets = {r.doc_id: shingles(r.text) for r in exact}
    link = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    left = {r.doc_id for r in near}
    assert not any(a < b and link(sets[a], sets[b]) for a in left for b in left)
    assert all(any(link(sets[a], sets[b]) for b in sets if b != a) for a in set(sets) - left)
    mixed = seen["source_mix"]
    assert {r.doc_id for r in mixed} <= left and max([r.doc_id for r in mixed].count(i) for i in left) <= 2
    enc = bpe.encoding(bpe.ranks(bpe.RANKS), public_tokenizers.PATTERN)
    digest = lambda t: hashlib.sha256(",".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in seen["byte_bpe"]) == sorted((r.doc_id, digest(r.text)) for r in mixed)


def test_stages_on_edges(spark):
    """Nulls in any column, empty and long texts, repeated rows, no rows, columns whose names are used inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, maybe int, node string, __h int, n_rows string, evidence double"
    long_text = "a fairly long sentence that goes on and on, " * 20000
    rows = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (None, "one two three four five six"), (4, long_text), (5, " \n"), (None, None)]
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None, k, k, "x", k, "y", 0.5) for k, (i, t) in enumerate(rows)], schema)
    for name, stage in P.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.where("false"), SF)
        assert none.count() == 0
        if name == P.STAGES[-1][0]:
            assert out.count() == len(rows)
        else:
            assert out.columns == docs.columns and out.count() <= 2 * len(rows)
        texts = [r.text for r in out.collect()] if "text" in out.columns else []
        if name == "exact_dedup":
            assert sorted(map(stripped, texts)) == sorted({stripped(t) for _, t in rows})
        if name == "ngram_jaccard_join":
            assert sum(t == rows[2][1] for t in texts) == 2 and sum(not stripped(t) for t in texts) == 4 and texts.count(long_text) == 1
