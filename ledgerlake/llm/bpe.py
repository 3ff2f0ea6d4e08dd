"""Byte-level BPE encoding and decoding by a global shuffle of distinct words (operator 2).

Texts are split into pre-tokens, and a chunk of texts becomes a dictionary of its distinct words and, for each text, the
positions as places in that dictionary. The dictionaries' words meet in one global shuffle, each distinct word is merged
once, its ids are joined back to the dictionaries, and texts are put together again by position. Decoding joins ids with
the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_batches, staged, table, tidy

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of a chunk, whose texts share a dictionary (a longer text is a chunk of its own); bytes of text for each
#: bucket of words; bytes up to which a vocabulary may be sent to all workers; words that are packed, unpacked or put
#: together at once (a longer text by itself).
CHUNK_CHARS, BUCKET_BYTES, TABLE_BYTES, WORDS_AT_ONCE = 32 << 20, 16 << 20, 64 << 20, 1 << 18
#: Bytes of text for each partition of a shuffle, where that makes more of them than the session has.
PARTITION_BYTES = 32 << 20


@lru_cache(4)
def ranks(path: str) -> bytes:
    """The rank file; the driver reads it, workers get it with the task."""
    with open(path, "rb") as f:
        out = f.read(TABLE_BYTES + 1)
    if len(out) > TABLE_BYTES:
        raise ValueError(f"{path} is larger than {TABLE_BYTES} bytes")
    return out


@lru_cache(2)
def token_bytes(rank_file: bytes) -> list[bytes | None]:
    """The token-byte table: the bytes of each id."""
    pairs = [(int(r), base64.b64decode(t)) for t, r in map(bytes.split, rank_file.splitlines()) if t]
    out: list[bytes | None] = [None] * (max((r for r, _ in pairs), default=-1) + 1)
    for r, t in pairs:
        out[r] = t
    return out


@lru_cache(2)
def encoding(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: r for r, t in enumerate(token_bytes(rank_file)) if t is not None}, special_tokens={})


class Places(dict):
    """Words by first use; a word that isn't there yet gets the next place."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


WORDS, TEXTS = 0, 1
MESSAGE = "kind int, chunk string, bucket int, places binary, lens binary, data binary, keys array<long>"
MESSAGE_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.string()), ("bucket", pa.int32()), ("places", pa.binary()), ("lens", pa.binary()), ("data", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _packed(values: np.ndarray | bytes) -> bytes:
    """Unsigned 32-bit values byte plane by byte plane, which compress well; or bytes as they are."""
    if not isinstance(values, bytes):
        values = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(values)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


#: Places below FEW take one byte; others a byte and two more, or four in very large dictionaries.
FEW, FAR = 224, 31


def _packed_places(places: np.ndarray) -> bytes:
    """Places by frequency, small ones short, each kind of byte by itself."""
    heads, highs, lows, raws, n_near = [], [], [], [], 0
    for k in range(0, len(places), WORDS_AT_ONCE):
        some = places[k : k + WORDS_AT_ONCE]
        rest = some - FEW
        far = np.minimum(rest >> 16, FAR)
        heads.append(np.where(rest < 0, some, FEW + far).astype(np.uint8).tobytes())
        near = rest[(rest >= 0) & (far < FAR)]
        highs.append((near >> 8 & 255).astype(np.uint8).tobytes())
        lows.append((near & 255).astype(np.uint8).tobytes())
        raws.append(rest[far == FAR].astype("<u4").tobytes())
        n_near += len(near)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64([len(places), n_near]).tobytes(), *heads, *highs, *lows, *raws]))


def _unpacked_places(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, np.int64, 2)
    head = np.frombuffer(raw, np.uint8, n, 16)
    high, low = (np.frombuffer(raw, np.uint8, m, 16 + n + k * m) for k in (0, 1))
    most = np.frombuffer(raw, "<u4", offset=16 + n + 2 * m)
    out, i, j = head.astype(np.int32), 0, 0
    for k in range(0, n, WORDS_AT_ONCE):
        some, own = head[k : k + WORDS_AT_ONCE], out[k : k + WORDS_AT_ONCE]
        near, far = np.flatnonzero((some >= FEW) & (some < FEW + FAR)), np.flatnonzero(some == FEW + FAR)
        own[near] = FEW + (own[near] - FEW << 16) + (high[i : i + len(near)].astype(np.int32) << 8) + low[i : i + len(near)]
        own[far] = most[j : j + len(far)].astype(np.int64) + FEW
        i, j = i + len(near), j + len(far)
    return out


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), MESSAGE_ARROW, strict=True)], schema=MESSAGE_ARROW)


@tidy
def _split(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to messages, chunk by chunk: the chunk's distinct words, for each bucket of words, and the
    chunk's texts as places, with the places of the words by bucket. Places go by frequency."""
    findall = regex.compile(pattern).findall
    part, n_chunks = TaskContext.get().partitionId(), 0
    seen, keys, codes, held = Places(), [], [], 0

    def chunk() -> Iterator[pa.RecordBatch]:
        name, words = f"{part}:{n_chunks}", list(seen)
        lens, flat = np.array([len(c) // 4 for c in codes]), np.concatenate([np.frombuffer(c, np.int32) for c in codes])
        codes.clear()
        place = np.empty(len(words), np.int32)
        place[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.int32)
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int32)
        bucket = np.fromiter((zlib.crc32(words[i].encode()) % buckets for i in by_word), np.int32, len(words))
        by_bucket = np.argsort(bucket, kind="stable")
        order, bucket = by_word[by_bucket], bucket[by_bucket]
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(order)]
        for a, b in pairwise(edges):  # none, if no text has a word
            raws = [words[i].encode() for i in order[a:b]]
            yield _messages([(WORDS, name, int(bucket[a]), None, _packed(np.array([len(w) for w in raws])), _packed(b"".join(raws)), None)])
        flat = place[flat]
        yield _messages([(TEXTS, name, None, _packed(place[order]), _packed(lens), _packed_places(flat), keys)])

    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            keys.append(key)
            words = findall(text or "")
            codes.append(array("i", [seen[w] for w in words]).tobytes())
            held += len(text or "")
            if held >= CHUNK_CHARS:
                yield from chunk()
                seen, keys, codes, held, n_chunks = Places(), [], [], 0, n_chunks + 1
    if keys:
        yield from chunk()


@tidy
def _merge(batches: Iterator[pa.RecordBatch], rank_file: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """Messages of words, by bucket, to messages of their ids. A bucket's distinct words are merged once each."""
    merge = encoding(rank_file, pattern)._core_bpe.encode_single_piece
    now, known = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                now, known = row["bucket"], {}
            raw, ids = zstandard.ZstdDecompressor().decompress(row["data"]), []
            ends = np.cumsum(_unpacked(row["lens"])).tolist()
            for start, end in zip([0, *ends], ends):  # noqa: B905
                word = raw[start:end]
                got = known.get(word)
                if got is None:
                    got = known[word] = merge(word)
                ids.append(got)
            yield _messages([(WORDS, row["chunk"], row["bucket"], None, _packed(np.array([len(x) for x in ids])), _packed(np.array([i for x in ids for i in x])), None)])


@tidy
def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages by chunk, ids by bucket before texts: the ids of each text, put together by position."""
    now, found = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] != now:
                now, found = row["chunk"], []
            if row["kind"] == WORDS:
                found.append((_unpacked(row["lens"]), _unpacked(row["data"])))
                continue
            lens, ids = (np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in range(2))
            order = np.argsort(_unpacked(row["places"]))
            starts, lens = (np.cumsum(lens) - lens)[order], lens[order]
            codes, ends = _unpacked_places(row["data"]), np.cumsum(_unpacked(row["lens"]))
            a = begin = 0
            while a < len(ends):  # some texts at a time
                b = max(a + 1, int(np.searchsorted(ends, begin + WORDS_AT_ONCE, "right")))
                part = codes[begin : ends[b - 1]]
                n = lens[part]
                upto = np.concatenate([[0], np.cumsum(n)])
                out = ids[np.repeat(starts[part] - upto[:-1], n) + np.arange(upto[-1])].astype(np.int32)
                edges = upto[np.concatenate([[0], ends[a:b] - begin])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"][a:b], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(out))], names=["doc_id", "ids"])
                a, begin = b, ends[b - 1]


def _assembled_digests(batches: Iterator[pa.RecordBatch], rank_file: bytes) -> Iterator[pa.RecordBatch]:
    """Messages by chunk to digests of the ids of each text, in one worker."""
    return _digests(_assemble(batches), rank_file)


def _by_chunk(docs: DataFrame, id_col: str, text_col: str, rank_path: str, pattern: str) -> DataFrame:
    """Messages by chunk, the ids of the distinct words before the texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rank_file = ranks(rank_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, size // BUCKET_BYTES)
    sent = staged(rows.mapInArrow(partial(_split, pattern=pattern, buckets=buckets), MESSAGE), "bpe-chunks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    words = sent.where(F.col("kind") == WORDS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    merged = words.mapInArrow(partial(_merge, rank_file=rank_file, pattern=pattern), MESSAGE)
    return merged.unionByName(sent.where(F.col("kind") == TEXTS)).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, each match of pattern merged by itself, no special tokens.

    One row per row of docs; a null or empty text has no ids; ids of rows may be null or repeat; other columns don't
    matter; no rows give no rows. The vocabulary has to hold all 256 single bytes.
    """
    return _by_chunk(docs, id_col, text_col, rank_path, pattern).mapInArrow(_assemble, "doc_id long, ids array<int>")


def decoded_bytes(ids: list[int], tokens: list[bytes | None]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def _decode(batches: Iterator[pa.RecordBatch], rank_file: bytes) -> Iterator[pa.RecordBatch]:
    tokens = token_bytes(rank_file)
    for batch in batches:
        out = [decoded_bytes(x or [], tokens) for x in batch.column("ids").to_pylist()]
        yield batch.append_column("data", pa.array(out, pa.binary()))


def decode(encoded: DataFrame, rank_path: str = RANKS) -> DataFrame:
    """encoded(doc_id, ids) with data: the bytes of the ids, by a join with the token-byte table that every worker holds;
    its size is the vocabulary's, at most TABLE_BYTES. Null ids are none; an id that isn't in the table is an error."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, rank_file=ranks(rank_path)), "doc_id long, ids array<int>, data binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch], rank_file: bytes) -> Iterator[pa.RecordBatch]:
    tokens = token_bytes(rank_file)
    decimal = [str(i).encode() for i in range(len(tokens))]
    for batch in batches:
        n, hashes = [], []
        for x in batch.column("ids"):
            ids = x.values.tolist() if x.is_valid else []
            n.append(len(ids))
            hashes.append((hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(decoded_bytes(ids, tokens)).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([h[k] for h in hashes], pa.string()) for k in (0, 1))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, rank_path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded(doc_id, ids): what decode() returns, hashed in place."""
    bounded_batches(encoded.sparkSession)
    return encoded.mapInArrow(partial(_digests, rank_file=ranks(rank_path)), DIGESTS)


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """digests(encode(docs)), where the ids of a text don't leave the worker that puts them together."""
    return _by_chunk(docs, id_col, text_col, rank_path, pattern).mapInArrow(partial(_assembled_digests, rank_file=ranks(rank_path)), DIGESTS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
