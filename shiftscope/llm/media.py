"""Media columns: bytes kept as 8-bit WAV, read back by the wave module, with spectral-peak pair fingerprints.

`store` turns a text's UTF-8 bytes, with zero bytes up to a positive multiple of `UNIT`, into an 8-bit mono WAV
(one sample a byte, so lossless) in a binary column, and writes the table. `features` opens each stored value
with the wave module and computes, over the whole signal:

* a short-time Fourier transform, Hann window of FRAME samples, a hop of HOP, with zeros before and after the signal
  so that every sample lies in FRAME / HOP frames and one UNIT gives several;
* the PEAKS strongest local maxima over frequency in each frame, the mean level taken off;
* landmarks: each peak paired with all peaks kept of the next REACH frames, as codes
  (frequency 1, frequency 2, frames between) at a time (the frame); `landmarks` is an array of
  struct<t, code> by time then code.

Frames are transformed in bounded groups, so memory doesn't follow a text's length. Equal texts give equal
values. Null counts as empty: one unit of zero bytes, no landmarks. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT, RATE = 64, 8000
FRAME, HOP, PEAKS, REACH = 128, 32, 2, 2
#: Frames transformed at once.
GROUP = 1024


def to_wav(data: bytes) -> tuple[bytes, int]:
    """The WAV file of these bytes, and how many they were."""
    payload = data + bytes(-len(data) % UNIT or (0 if data else UNIT))
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue(), len(data)


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> np.ndarray:
    """(frames, PEAKS) frequency bins of each frame's strongest local maxima, strongest first; 0: none."""
    frames = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    if len(samples):
        padded[: len(samples)] -= np.float32(samples.mean(dtype=np.float64))
    out = np.zeros((frames, PEAKS), np.int32)
    for g in range(0, frames, GROUP):
        n = min(GROUP, frames - g)
        view = np.lib.stride_tricks.sliding_window_view(padded[g * HOP : (g + n - 1) * HOP + FRAME], FRAME)[::HOP]
        spectrum = np.fft.rfft(view * _WINDOW, axis=1)
        level = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        inner = level[:, 1:-1]
        inner = np.where((inner > level[:, :-2]) & (inner >= level[:, 2:]), inner, 0)
        for k in range(PEAKS):
            best = inner.argmax(axis=1)
            rows = np.arange(n)
            out[g : g + n, k] = np.where(inner[rows, best] > 0, best + 1, 0)
            inner[rows, best] = 0
    return out


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs, by time then code."""
    level = samples.astype(np.float32) - np.float32(samples.mean(dtype=np.float64)) if len(samples) else samples
    found = peaks(np.pad(level, FRAME - HOP))
    times, codes = [], []
    for gap in range(1, REACH + 1):
        for k, other in product(range(PEAKS), repeat=2):
            first, second = found[:-gap, k].astype(np.int64), found[gap:, other].astype(np.int64)
            there = np.flatnonzero((first > 0) & (second > 0))
            times.append(there)
            codes.append(first[there] << 12 | second[there] << 2 | gap)
    t, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, t))
    return t[order].astype(np.int32), code[order].astype(np.int32)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a WAV file): written to the shared folder and read from there."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, most=8 << 20):
            made = [to_wav(x) for x in common.encoded(block.column("text"))]
            yield from common.emit({"doc_id": block.column("doc_id").cast(pa.int64()), "n_bytes": [n for _, n in made], "media": [m for m, _ in made]}, schema, 2000)

    return common.written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


def features(stored: DataFrame) -> DataFrame:
    """What reading each stored file gives: payload figures and landmarks."""
    pair = pa.struct([("t", pa.int32()), ("code", pa.int32())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("landmarks", pa.list_(pair))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "media", 8 << 20):
            out: dict[str, list] = {f.name: [] for f in schema}
            times, codes, ends = [], [], [0]
            for media in common.encoded(block.column("media")):
                payload = from_wav(media)
                t, code = landmarks(np.frombuffer(payload, np.uint8))
                times.append(t)
                codes.append(code)
                ends.append(ends[-1] + len(t))
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(times)), pa.array(np.concatenate(codes))], fields=list(pair))
            out |= {"doc_id": block.column("doc_id"), "n_bytes": block.column("n_bytes"), "landmarks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=pa.list_(pair))}
            yield from common.emit(out, schema, 500)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, landmarks array<struct<t:int,code:int>>"
    return stored.mapInArrow(run, kinds)


def feature_text(landmarks_column: str = "landmarks"):
    """A column: the landmarks as t:code, space-joined."""
    return F.array_join(F.transform(landmarks_column, lambda x: F.concat_ws(":", x["t"], x["code"])), " ")
