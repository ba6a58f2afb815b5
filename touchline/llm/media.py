"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak pairs.

``wav_features`` stores each payload as an 8-bit mono WAV file (a binary column), reads
it back with the ``wave`` module and fingerprints it: local peaks of the log spectrogram
are paired with the next peaks in time, each pair is coded (frequency, frequency, time
step) and stored in two parallel arrays, ``codes`` and ``times``.

Defined cases: a null text counts as empty; an empty payload becomes 64 zero bytes;
repeated rows give repeated results; an empty table gives an empty table; any further
columns of the input are left out, so names cannot clash.  A text of any length is transformed
whole, in blocks of frames: some five bytes of memory a byte of text.
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
from pyspark.sql import functions as F

from .encoding import slices
from .store import read_columns

UNIT = 64  # payload bytes are a positive multiple of it
RATE = 8000  # samples a second
WINDOW, HOP = 512, 256  # samples of a frame, and between frames
FREQ_NEAR, TIME_NEAR = 6, 2  # a peak is the largest within so many bins and frames
FAN_OUT, TIME_SPAN = 3, 63  # pairs with the next peaks, at most so many frames later
LEVELS = 16.0  # steps of log2 magnitude; coarse, so that rounding does not move peaks
SLICE_BYTES = 64 << 20  # of texts handled at once, unless one alone is longer
BLOCK = 4096  # frames transformed at once: bounds memory for long payloads

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media binary, codes array<int>, times array<int>"
)


def to_wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file, without loss."""
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


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def spectrogram(samples: bytes) -> np.ndarray:
    """Quantised log2 magnitudes, frames by WINDOW // 2 bins (the constant bin is left out)."""
    raw = np.frombuffer(samples, np.uint8)
    n = max(1, 1 + -(-(len(raw) - WINDOW) // HOP))
    shape = np.hanning(WINDOW).astype(np.float32)
    out = np.empty((n, WINDOW // 2), np.int16)
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        x = raw[at * HOP : (at + m - 1) * HOP + WINDOW].astype(np.float32) - np.float32(128.0)
        x = np.pad(x, (0, (m - 1) * HOP + WINDOW - len(x)))
        frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(frames * shape, axis=1)[:, 1:])
        out[at : at + m] = np.rint(np.log2(power + 1.0) * LEVELS)
    return out


def _spread(a: np.ndarray, near: int, axis: int) -> np.ndarray:
    """Maximum within ``near`` places on both sides along an axis."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (near, near)
    p = np.pad(a, pad, constant_values=-1)
    out, n = a.copy(), a.shape[axis]
    for k in range(2 * near + 1):
        if k != near:
            np.maximum(out, p[k : k + n] if axis == 0 else p[:, k : k + n], out=out)
    return out


def peak_pairs(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and times of peak pairs, and the number of peaks.

    A peak is a level above the mean that none of its neighbours exceeds; of equal
    neighbours all are peaks.  Peak i is paired with peaks i+1 .. i+FAN_OUT in (time,
    frequency) order if they are at most TIME_SPAN frames later.
    """
    mean, found = levels.mean(), []
    for at in range(0, len(levels), BLOCK):  # with the frames that a block's peaks are held against
        low = max(0, at - TIME_NEAR)
        part = levels[low : at + BLOCK + TIME_NEAR]
        near = _spread(_spread(part, FREQ_NEAR, 1), TIME_NEAR, 0)
        here = slice(at - low, at - low + min(BLOCK, len(levels) - at))
        rows, bins = np.nonzero((part[here] == near[here]) & (part[here] > mean))
        found.append((rows + at, bins))
    t, f = (np.concatenate(x) for x in zip(*found))
    codes, times = [], []
    for k in range(1, FAN_OUT + 1):
        dt = t[k:] - t[:-k]
        ok = dt <= TIME_SPAN
        codes.append(((f[:-k] << 14) | (f[k:] << 6) | dt)[ok])
        times.append(t[:-k][ok])
    if not codes or not len(t):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((code, time))
    return code[order].astype(np.int32), time[order].astype(np.int32), len(t)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 256, SLICE_BYTES):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                text = text or b""
                media = to_wav(padded(text))
                back = from_wav(media)
                codes, times, _ = peak_pairs(spectrogram(back))
                rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), media, codes, times))
            cols = list(zip(*rows))
            yield pa.record_batch(
                [
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary()),
                    _lists(cols[6]), _lists(cols[7]),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "codes", "times"],
            )


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), pa.int32()))


def wav_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the stored WAV file and its fingerprint arrays; no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_batches, SCHEMA)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wav_features(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    arrays = F.concat_ws("|", F.array_join("codes", ","), F.array_join("times", ","))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes"), F.sha2(arrays, 256)).alias("feature"),
        F.size("codes").cast("long").alias("n_pairs"), "codes", "times",
    )
