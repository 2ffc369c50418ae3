"""Audio columns: lossless 8-bit PCM in WAV, and log-mel features with energy segments.

The stored bytes are read back, resampled by a polyphase filter, cut into overlapped frames, and turned into log-mel
blocks of a fixed shape, which a column holds as Arrow fixed-shape tensors with the time span of every block.
Segments come from frame energies with hysteresis.  Rows are independent: one pass, no shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm._text import slices


_BLOCK = 1 << 18  # samples or outputs that are worked on at once, so that long texts take memory by their size only


@dataclass(frozen=True)
class AudioShape:
    """Rates in samples a second; frame and hop in samples at ``rate``; block in frames."""

    stored_rate: int = 16_000
    rate: int = 8_000
    frame: int = 256
    hop: int = 128
    mels: int = 20
    block: int = 64
    rise_db: float = 3.0
    stay_db: float = 0.5


# ---- the stored form ------------------------------------------------------------------------------------------------


def write_wav(samples: bytes, rate: int) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def read_wav(raw: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file with one channel of 8-bit PCM."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<4sI", raw, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit PCM")
        elif kind == b"data":
            return raw[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


# ---- features -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """Taps of a windowed-sinc low-pass filter, a row for each of the ``up`` phases, for samples in ascending order."""
    wide = half * max(up, down)
    t = np.arange(-wide, wide + 1)
    taps = np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1]
    taps *= up / taps.sum()
    width = -(-len(taps) // up)
    taps = np.concatenate((taps, np.zeros(width * up - len(taps))))
    return np.ascontiguousarray(taps.reshape(width, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Polyphase resampling by to / rate, in blocks; outputs are centred on their instants, and the ends see zeros."""
    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not len(x):
        return x.astype(np.float32)
    taps = _phases(up, down)
    width, delay = taps.shape[1], (8 * max(up, down))
    n = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(width, np.float32), x.astype(np.float32), np.zeros(width + 1, np.float32)))
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    for start in range(0, n, _BLOCK):
        at = np.arange(start, min(start + _BLOCK, n))
        for p in range(up):
            # Output m reads up-sampled position m * down + delay; those with one remainder by up share a phase.
            m = at[(at * down + delay) % up == p]
            newest = (m * down + delay) // up
            out[m] = views[np.minimum(newest + 1, len(views) - 1)] @ taps[p]
    return out


@lru_cache(maxsize=16)
def _mel_bank(shape: AudioShape) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, to_mel(shape.rate / 2), shape.mels + 2) / 2595) - 1)
    bins = np.arange(shape.frame // 2 + 1) * shape.rate / shape.frame
    left, mid, right = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid))).T.astype(np.float32)


def log_mel(x: np.ndarray, shape: AudioShape) -> np.ndarray:
    """Log energies (frames, mels) of overlapped Hann frames, in blocks; the last frame is filled with zeros."""
    n = 1 + max(0, -(-(len(x) - shape.frame) // shape.hop))
    padded = np.zeros((n - 1) * shape.hop + shape.frame, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, shape.frame)[:: shape.hop]
    window, bank, out = np.hanning(shape.frame).astype(np.float32), _mel_bank(shape), np.empty((n, shape.mels), np.float32)
    step = max(1, _BLOCK // shape.frame)
    for start in range(0, n, step):
        spectrum = np.fft.rfft(frames[start : start + step] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[start : start + step] = np.log(power @ bank + 1e-6)
    return out


def segments(energy_db: np.ndarray, shape: AudioShape) -> list[tuple[float, float]]:
    """Spans in seconds of frame runs that stay ``stay_db`` above the median and somewhere rise ``rise_db`` above it."""
    low = energy_db >= np.median(energy_db) + shape.stay_db
    high = energy_db >= np.median(energy_db) + shape.rise_db
    edge = np.diff(np.concatenate(([0], low.astype(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    rises = np.concatenate(([0], np.cumsum(high)))
    keep = rises[stop] > rises[start]
    hop = shape.hop / shape.rate
    return [(float(a * hop), float((b - 1) * hop + shape.frame / shape.rate)) for a, b in zip(start[keep], stop[keep], strict=True)]


def tensor_bytes(mel: np.ndarray, shape: AudioShape) -> bytes:
    """An Arrow stream of (tensor, start_s, end_s): blocks of a fixed shape, the last filled with the smallest value."""
    n = max(1, -(-len(mel) // shape.block))
    blocks = np.full((n * shape.block, shape.mels), np.float32(np.log(1e-6)), np.float32)
    blocks[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [shape.block, shape.mels])
    cells = pa.FixedSizeListArray.from_arrays(pa.array(blocks.ravel()), shape.block * shape.mels)
    hop = shape.hop / shape.rate
    start = np.arange(n) * shape.block * hop
    end = (np.minimum((np.arange(n) + 1) * shape.block, len(mel)) - 1) * hop + shape.frame / shape.rate
    batch = pa.record_batch([pa.ExtensionArray.from_storage(kind, cells), pa.array(start), pa.array(end)], ["tensor", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features(media: bytes, shape: AudioShape) -> tuple[bytes, np.ndarray, list[tuple[float, float]]]:
    """Of stored bytes: the samples read back, the log-mel frames and the segments."""
    samples, rate = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, rate, shape.rate), shape)
    energy = 10 * np.log10(np.exp(mel).sum(axis=1) + 1e-9)
    return samples, mel, segments(energy, shape)


def audio_columns(docs: DataFrame, shape: AudioShape = AudioShape()) -> DataFrame:  # noqa: B008
    """Each text's bytes as stored audio, with its features.

    The payload is the text in UTF-8 and as many bytes 0 as make a positive multiple of 64.  Returns doc_id, n_bytes
    (unpadded), media (WAV), samples (read back from media), tensors (an Arrow stream of fixed-shape tensors with time
    spans), n_frames, mel_means and segments.  A null text counts as empty and is 64 bytes 0; equal texts give equal
    values; long texts are features of their whole bytes, worked through in blocks; repeated rows and other columns
    change nothing; an empty table gives an empty result.
    """
    out = "doc_id bigint, n_bytes bigint, media binary, samples binary, tensors binary, n_frames bigint, mel_means array<double>, segments array<struct<start_s: double, end_s: double>>"
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", rows=512):
                made: dict[str, list] = {k: [] for k in ("n_bytes", "media", "samples", "tensors", "n_frames", "mel_means", "segments")}
                for text in batch.column("text").to_pylist():
                    payload = (text or "").encode()
                    n = len(payload)
                    media = write_wav(payload.ljust(max(64, -(-n // 64) * 64), b"\0"), shape.stored_rate)
                    samples, mel, spans = features(media, shape)
                    values = (n, media, samples, tensor_bytes(mel, shape), len(mel), mel.mean(axis=0, dtype=np.float64), [{"start_s": a, "end_s": b} for a, b in spans])
                    for k, v in zip(made, values, strict=True):
                        made[k].append(v)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64()), span)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(made.values(), kinds, strict=True))], ["doc_id", *made])

    return docs.select("doc_id", "text").mapInArrow(rows, out)
