"""Media columns: texts as WAV files, and fingerprints of them.

A text's UTF-8 bytes become the samples of an 8-bit mono WAV file, which is kept as a binary column.
The fingerprint operator reads that file with the wave module, takes a short-time Fourier transform,
finds spectral peaks and codes pairs of near peaks together with the frame at which they start.

Defined results: a null text is the empty text; the empty text is one block of 192 spaces. Ties
between equal bins make every one of them a peak. Equal texts give equal media and equal codes.
A very long text is transformed
a few thousand frames at once; an empty table has no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, small_batches, text_of

BLOCK, HOP, RATE = 192, 96, 8000
#: Half widths of the neighbourhood in which a peak is the largest value: frames and bins.
NEAR_T, NEAR_F = 2, 5
#: Partners of a peak, the next ones in later frames, and the most frames between two partners.
FAN_OUT, REACH = 4, 32
FRAMES_AT_ONCE = 4096

_BINS = BLOCK // 2 + 1
_WINDOW = np.hanning(BLOCK)


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_payload(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(text: bytes) -> bytes:
    """`text` with bytes 32 up to a positive multiple of the block."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b" ")


def levels(samples: np.ndarray) -> np.ndarray:
    """Frames by bins: the logarithm of the magnitudes in whole steps, a few thousand frames at once."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[::HOP]
    out = np.empty((len(frames), _BINS), np.int16)
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        part = (frames[i : i + FRAMES_AT_ONCE].astype(np.float64) - 128.0) * _WINDOW
        out[i : i + FRAMES_AT_ONCE] = np.floor(8 * np.log2(1 + np.abs(np.fft.rfft(part, axis=1))) + 1e-6)
    return out


def _largest_near(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    y = np.pad(x, pad, constant_values=-1)
    n = x.shape[axis]
    out = np.full_like(x, -1)
    for k in range(2 * reach + 1):
        np.maximum(out, y[k : k + n] if axis == 0 else y[:, k : k + n], out=out)
    return out


def codes(payload: bytes) -> np.ndarray:
    """Time-coded fingerprints: frame << 20 | bin << 13 | bin of the partner << 6 | frames between them."""
    x = levels(np.frombuffer(payload, np.uint8))
    t, f = np.nonzero((x == _largest_near(_largest_near(x, NEAR_T, 0), NEAR_F, 1)) & (x > 0))
    after = np.searchsorted(t, t, side="right")  # the first peak of a later frame
    found = []
    for k in range(FAN_OUT):
        i = np.flatnonzero(after + k < len(t))
        j = after[i] + k
        gap = t[j] - t[i]
        ok = gap <= REACH
        found.append((t[i].astype(np.int64) << 20 | f[i] << 13 | f[j] << 6 | gap)[ok])
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the WAV file of each text."""
    docs = small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.encode() for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([wav_bytes(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def fingerprint(media: DataFrame) -> DataFrame:
    """Reads the stored files of `encode` and adds digests and the time-coded array `codes`."""
    media = small_batches(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                stored = m.as_py()
                payload = wav_payload(stored)
                c = codes(payload)
                feature = f"{len(c)}:{hashlib.sha256(c.astype('<i8').tobytes()).hexdigest()}"
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, c))
            cols = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codes"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codes array<long>")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(encode(documents(spark, sf_dir)))
