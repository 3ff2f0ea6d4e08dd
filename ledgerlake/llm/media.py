"""Media columns (operator 6): texts stored as 8-bit WAV, spectra and spectral-peak pair fingerprints of what is read back."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_batches, table

RATE, PAD = 8000, 64
#: Samples of a frame at most and at least, frames that a payload has at least if it can, frames transformed at once.
FRAME, LEAST_FRAME, FRAMES, AT_ONCE = 1024, 16, 16, 4096
#: Where the bands begin, each of which may have one peak a frame, as shares of a frame's bins; frames ahead that a peak
#: is paired with.
BANDS, AHEAD = (0, 1 / 32, 3 / 32, 1 / 4, 1), 2


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def frame_size(n: int) -> int:
    """Samples of a frame of n samples: a power of two, small enough for FRAMES frames that overlap by half."""
    return max(LEAST_FRAME, min(FRAME, 1 << max(0, (2 * n // (FRAMES + 1)).bit_length() - 1)))


def peaks(samples: np.ndarray) -> np.ndarray:
    """Frame by band: the bin of the band's largest magnitude, or -1 where it isn't above the frame's mean by half.
    Frames overlap by half and are transformed AT_ONCE at a time, so memory doesn't follow the length; the last frame is
    filled with silence."""
    size = frame_size(len(samples))
    hop, bins = size // 2, size // 2 + 1
    edges = sorted({max(1, round(x * (bins - 1))) for x in BANDS[:-1]}) + [bins]
    n = max(1, -(-max(0, len(samples) - size) // hop) + 1)
    window, found = np.hanning(size), []
    for k in range(0, n, AT_ONCE):
        m = min(AT_ONCE, n - k)
        part = samples[k * hop : (k + m - 1) * hop + size].astype(np.float64) - 128.0
        part = np.pad(part, (0, (m - 1) * hop + size - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, size)[::hop]
        power = np.abs(np.fft.rfft(frames * window, axis=1))
        floor = 1.5 * power[:, 1:].mean(axis=1)
        best = np.empty((m, len(edges) - 1), np.int64)
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            at = power[:, lo:hi].argmax(axis=1) + lo
            best[:, b] = np.where(power[np.arange(m), at] > floor, at, -1)
        found.append(best)
    return np.concatenate(found)


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of each pair of a peak with a peak of the same or the next band, 1 to AHEAD frames later.
    Code: bin << 16 | later bin << 4 | frames between. In order of time, then code."""
    times, codes = [], []
    for d in range(1, AHEAD + 1):
        for b in range(found.shape[1]):
            for c in (b, b + 1):
                if c < found.shape[1] and len(found) > d:
                    x, y = found[:-d, b], found[d:, c]
                    t = np.flatnonzero((x >= 0) & (y >= 0))
                    times.append(t)
                    codes.append(x[t] << 16 | y[t] << 4 | d)
    t, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (times, codes))
    order = np.lexsort((c, t))
    return t[order], c[order]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        raw = [x or b"" for x in texts]
        media = [to_wav(x + b"\0" * (-len(x) % PAD or (0 if x else PAD))) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a WAV file of 8-bit samples, filled with bytes 0 up to a positive
    multiple of PAD. A null text is empty. One row per row, in any order."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<struct<time:int,code:long>>"


def _listen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = pa.list_(pa.struct([("time", pa.int32()), ("code", pa.int64())]))
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        prints, ends = [], [0]
        for x in batch.column("media"):
            media = x.as_py()
            payload = from_wav(media)
            t, c = pairs(peaks(np.frombuffer(payload, np.uint8)))
            prints.append((t, c))
            ends.append(ends[-1] + len(t))
            feature = f"{len(t)}:" + hashlib.sha256(np.stack([t, c]).astype("<i8").tobytes()).hexdigest()
            for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                column.append(value)
        t, c = (np.concatenate([p[k] for p in prints]) if prints else np.empty(0, np.int64) for k in (0, 1))
        struct = pa.StructArray.from_arrays([pa.array(t.astype(np.int32)), pa.array(c.astype(np.int64))], fields=list(code.value_type))
        arrays = [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], names=names)


def fingerprinted(media: DataFrame) -> DataFrame:
    """FEATURES of media(doc_id, n_bytes, media), from the bytes read back. fingerprint: time-coded peak pairs;
    feature: their number and digest. Equal payloads give equal values."""
    bounded_batches(media.sparkSession)
    return media.mapInArrow(_listen, FEATURES)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(stored(table(spark, sf_dir, "documents")))
