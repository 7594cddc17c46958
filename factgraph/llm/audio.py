"""Byte payloads as 8-bit sound, and log-mel features of them.

``encode_wav`` stores a padded payload losslessly as the 8-bit samples of a mono WAVE file;
``audio_features`` reads the samples back, resamples them with a polyphase filter, takes overlapped
log-mel filterbanks and cuts them into segments by energy with hysteresis. Features of a row depend on
its samples alone, so equal payloads give equal values. Frames are made in blocks: memory does not grow
with a row's length beyond its own samples. Null and empty payloads become 64 zero bytes. Repeated rows come back
as often, an empty table gives an empty one; columns outside ``keep`` are not read, and one named like a result
(payload, n_frames, tensors, segments, feature) can't be kept.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import released

RATE, UP, DOWN = 16_000, 3, 8
FRAME, HOP, MELS, BLOCK = 256, 128, 32, 64
#: Decibels over the row's mean at which a segment starts, and below which it ends.
HIGH_DB, LOW_DB = 0.5, -0.5
ALIGN = 64


def filter_taps(up: int = UP, down: int = DOWN, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc low-pass for the polyphase resampler, of 2 * half * max(up, down) + 1 taps."""
    widest = max(up, down)
    n = np.arange(-half * widest, half * widest + 1)
    taps = np.sinc(n / widest) * np.hanning(len(n) + 2)[1:-1]
    return (up * taps / taps.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output m is the sum of x[k] * taps[half + m * down - k * up], so only needed products are formed."""
    taps = filter_taps(up, down)
    half = len(taps) // 2
    n_out = -(-len(x) * up // down)
    out = np.empty(n_out, np.float32)
    for phase in range(min(up, n_out)):  # outputs with equal (m * down) % up use the same taps
        m = np.arange(phase, n_out, up)
        offset = (phase * down) % up
        first = -((half - offset) // up)  # smallest k - base with a tap
        picks = np.arange(half + offset - first * up, -1, -up)
        kernel = taps[picks[picks < len(taps)]]
        first += int((picks >= len(taps)).sum())
        base = phase * down // up
        padded = np.concatenate([np.zeros(max(0, -(base + first)), np.float32), x, np.zeros(len(kernel) + down, np.float32)])
        start = base + first + max(0, -(base + first))
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([padded, np.zeros(down * len(m) + start, np.float32)])[start:], len(kernel))[::down][: len(m)]
        out[m] = windows @ kernel
    return out


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles on the mel scale, (frame // 2 + 1, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    points = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    freqs = np.linspace(0, rate / 2, frame // 2 + 1)
    up = (freqs[:, None] - points[None, :-2]) / (points[1:-1] - points[:-2])
    down = (points[None, 2:] - freqs[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_BANK, _WINDOW = mel_bank(RATE * UP / DOWN), np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) log energies of overlapped frames; a short signal is padded to one frame."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 512):
        spectrum = np.fft.rfft(frames[at : at + 512] * _WINDOW)
        out[at : at + 512] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _BANK
    return np.log(out + np.float32(1e-6))


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, end): opened at HIGH_DB over the mean energy, closed below LOW_DB."""
    energy = 10 / np.log(10) * mel.mean(axis=1, dtype=np.float64)
    energy -= energy.mean()
    state = np.where(energy >= HIGH_DB, 1, np.where(energy < LOW_DB, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    held = np.zeros(len(state), np.int64)
    held[marks] = marks
    held = np.maximum.accumulate(held)
    on = np.concatenate([[0], (state[held] == 1).astype(np.int8), [0]])
    on[1 : marks[0] + 1] = 0
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def pad(data: bytes) -> bytes:
    return data + bytes(max(ALIGN, -(-len(data) // ALIGN) * ALIGN) - len(data))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframesraw(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def encode_wav(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Adds ``out``: a WAVE file of the row's bytes, zero-padded to a positive multiple of 64.

    The header is 44 fixed bytes with two lengths, so that a JVM expression writes it.
    """
    size = F.octet_length(F.col(payload))
    extra = F.greatest(F.lit(ALIGN), F.ceil(size / F.lit(ALIGN)) * F.lit(ALIGN)).cast("int") - size
    padded = F.concat(F.col(payload), F.unhex(F.repeat(F.lit("00"), extra)))

    def little(x):
        h = F.lpad(F.hex(x.cast("long")), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))

    total = size + extra
    fixed = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"
    return df.withColumn(out, F.concat(F.lit(bytearray(b"RIFF")), little(total + F.lit(36)), F.lit(bytearray(fixed)), little(total), padded))


#: tensors: an Arrow stream of TENSORS, log-mel blocks of the fixed shape (BLOCK, MELS), the last one zero-padded, with their time spans.
TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("values", pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS)))])
SCHEMA = "payload binary, n_frames int, tensors binary, segments array<struct<start_s: double, end_s: double, mean_log_energy: double>>, feature string"


def describe(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]], str]:
    """Log-mel frames, segments, and a short text of both."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    mel = log_mel(resample(x))
    parts = segments(mel)
    mean = mel.mean(axis=0, dtype=np.float64)
    return mel, parts, f"frames={len(mel)};segments={len(parts)};mel=" + ",".join(f"{v:.2f}" for v in mean)


def audio_features(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), tensors: bool = True) -> DataFrame:
    """``keep`` columns, the samples read back from the WAVE bytes, and SCHEMA's features. ``tensors=False`` leaves them null; ``tensor_table`` reads them."""
    plain = df.select(*[F.col(c) for c in keep], F.col(media).alias("__media"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), SCHEMA])
    step, width = HOP * DOWN / (RATE * UP), FRAME * DOWN / (RATE * UP)
    types = {"segments": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_log_energy", pa.float64())]))}

    def blocks(mel: np.ndarray) -> bytes:
        n = -(-len(mel) // BLOCK)
        full = np.zeros((n * BLOCK, MELS), np.float32)
        full[: len(mel)] = mel
        first = np.arange(n) * BLOCK
        frames = np.minimum(len(mel) - first, BLOCK)
        values = pa.ExtensionArray.from_storage(TENSORS.field("values").type, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), BLOCK * MELS))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, TENSORS) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(first * step), pa.array((first + frames - 1) * step + width), pa.array(frames.astype(np.int32)), values], schema=TENSORS))
        return out.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                cols: list[list] = [[], [], [], [], []]
                for m in b.column(b.num_columns - 1).to_pylist():
                    samples = from_wav(m)
                    mel, parts, text = describe(samples)
                    cuts = [{"start_s": s * step, "end_s": (e - 1) * step + width, "mean_log_energy": float(mel[s:e].mean(dtype=np.float64))} for s, e in parts]
                    for c, v in zip(cols, (samples, len(mel), blocks(mel) if tensors else None, cuts, text), strict=True):
                        c.append(v)
                arrays = [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], types["segments"]), pa.array(cols[4], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*keep, "payload", "n_frames", "tensors", "segments", "feature"])

    return plain.mapInArrow(released(run), schema)


def tensor_table(data: bytes) -> pa.Table:
    """The stored tensors of a row: a table of TENSORS."""
    return pa.ipc.open_stream(data).read_all()
