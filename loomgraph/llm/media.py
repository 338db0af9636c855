"""Audio features of media columns.

A payload of 8-bit samples is kept losslessly as a WAV file in a binary column. Features are computed from the stored
bytes: polyphase resampling by 2/3, log-mel filterbanks over overlapping frames, and hysteresis segmentation of frame
energies. Frames are cut into patches of one fixed shape, in half precision; a document's patches with their time spans
are one Arrow IPC stream whose tensor column has the fixed_shape_tensor type. Signals are computed in stretches of
STRETCH samples with what overlaps, so that a long text needs no more memory than its features. Features are a table
to store; ``described`` reads the stored tensors and spans back.

Defined results: null text is an empty payload, which is padded like any other; equal payloads have equal features,
whatever rows surround them; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .common import released

RATE, UP, DOWN, TAPS = 12000, 2, 3, 16
FRAME, HOP, FFT, BANDS = 200, 80, 256, 20
#: Frames in a patch; the last one of a document is filled with zeros.
PATCH = 16
UNIT = 576
#: Decibels above a document's median frame energy at which a segment opens, and down to which it lasts.
OPEN_DB, STAY_DB = 1.5, 0.5
#: Samples in a stretch.
STRETCH = 3 << 16
TENSOR = pa.fixed_shape_tensor(pa.float16(), (PATCH, BANDS), dim_names=("frame", "band"))


def wav(samples: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(data: bytes) -> bytes:
    """The data chunk of a WAV file."""
    at = 12
    while data[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", data, at + 4)[0]
    return data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]


def _filters() -> np.ndarray:
    """UP x TAPS phases of a windowed-sinc low-pass filter."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.kaiser(n, 6.0)
    return (h / h.sum() * UP).reshape(TAPS, UP).T


def _mel() -> np.ndarray:
    """FFT bins x BANDS triangular filters, equally spaced on the mel scale."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))


_PHASES, _MEL, _WINDOW = _filters(), _mel(), np.hanning(FRAME)


def resample(x: np.ndarray, known: int = 0) -> np.ndarray:
    """x at UP / DOWN of its rate; each output is one phase's dot product. The first ``known`` samples are those before x, which has a multiple of DOWN."""
    steps = (len(x) - known) // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1 - known), x]) if known < TAPS - 1 else x
    out = np.zeros((steps, UP))
    for j in range(UP):
        shift = j * DOWN // UP
        for k in range(TAPS):
            lo = TAPS - 1 + shift - k
            out[:, j] += _PHASES[j * DOWN % UP, k] * padded[lo : lo + DOWN * steps : DOWN][:steps]
    return out.reshape(steps * UP)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames x BANDS, frame energies in dB) of one resampled signal."""
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * _WINDOW, FFT)) ** 2
    return np.log(power @ _MEL + 1e-6), 10 * np.log10((frames * frames).mean(1) + 1e-9)


def analysed(samples: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """log_mel of a payload of 8-bit samples, as if it were resampled at once."""
    mels, energies = [], []
    before, rest = np.zeros(TAPS - 1), np.zeros(0)
    for lo in range(0, len(samples), stretch):
        x = (samples[lo : lo + stretch].astype(np.float64) - 128) / 128
        joined = np.concatenate([before, x])
        y = np.concatenate([rest, resample(joined, TAPS - 1)])
        before = joined[len(joined) - (TAPS - 1) :]
        if len(y) >= FRAME:
            mel, energy = log_mel(y)
            mels.append(mel)
            energies.append(energy)
            rest = y[len(mel) * HOP :]
        else:
            rest = y
    return np.concatenate(mels), np.concatenate(energies)


def segments(energy: np.ndarray) -> np.ndarray:
    """(first, end) frames of runs that stay above the lower threshold and somewhere pass the upper one."""
    level = np.round(energy - np.median(energy), 6)
    low = np.concatenate([[0], (level > STAY_DB).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(low)).reshape(-1, 2)
    if not len(edge):
        return edge
    high = np.concatenate([[0], np.cumsum(level > OPEN_DB)])
    return edge[high[edge[:, 1]] > high[edge[:, 0]]]


def tensors(mel: np.ndarray, spans: np.ndarray) -> bytes:
    """Arrow IPC stream: start_ms, end_ms, active (share of segment frames) and a PATCH x BANDS tensor for each patch."""
    n = -(-len(mel) // PATCH)
    filled = np.zeros((n * PATCH, BANDS), np.float16)
    filled[: len(mel)] = mel
    active = np.zeros(n * PATCH, np.float32)
    for a, b in spans:
        active[a:b] = 1
    step = 1000 * HOP * DOWN / UP / RATE
    first = np.arange(n) * PATCH
    last = np.minimum(first + PATCH, len(mel)) - 1
    tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel(), pa.float16()), PATCH * BANDS))
    batch = pa.RecordBatch.from_arrays([pa.array(first * step), pa.array(last * step + 1000 * FRAME * DOWN / UP / RATE), pa.array(active.reshape(n, PATCH).mean(1)), tensor], ["start_ms", "end_ms", "active", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in tn.chunks(batch.column(1)):
            raw, at = data.tobytes(), off.tolist()
            texts = [raw[at[i] : at[i + 1]] for i in range(hi - lo)]
            files = [wav(t + b"\xff" * (max(1, -(-len(t) // UNIT)) * UNIT - len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, filled up with 0xFF to a positive multiple of UNIT, as a WAV file."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(_encode), f"doc_id {kind}, n_bytes long, media binary")


_SPANS = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
_STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, segments array<struct<start_ms:double,end_ms:double>>, tensors binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments", "tensors"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _SPANS, pa.binary()]
    step = 1000 * HOP * DOWN / UP / RATE
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part, rows = batch.slice(lo, 512), []
            for media in part.column(2):
                media = media.as_py()
                payload = wav_samples(media)
                mel, energy = analysed(np.frombuffer(payload, np.uint8))
                runs = segments(energy)
                spans = [{"start_ms": float(a * step), "end_ms": float(b * step)} for a, b in runs]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), spans, tensors(mel, runs)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)


def features(media: DataFrame) -> DataFrame:
    """Digests, number of frames, segment time spans and tensors of stored (doc_id, n_bytes, media)."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(released(_features), f"doc_id {kind}, {_STORED}")


def describe(frames: int, spans: list[dict], stored: bytes) -> str:
    """Frames x bands, segments, and a digest of the tensors and spans, which is what the feature string says."""
    patches = read_tensors(stored).column("log_mel").combine_chunks().storage.flatten().to_numpy()
    edges = np.array([[s["start_ms"], s["end_ms"]] for s in spans]).tobytes()
    return f"{frames}x{BANDS}/{len(spans)}/{hashlib.md5(patches.astype('<f2').tobytes() + edges).hexdigest()}"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frames, spans, stored = (batch.column(batch.num_columns - 3 + i) for i in range(3))
        told = [describe(f.as_py(), s.as_py(), t.as_py()) for f, s, t in zip(frames, spans, stored, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(told, pa.string())], [*batch.schema.names[:-3], "feature"])


def described(stored: DataFrame) -> DataFrame:
    """Stored features with a feature string that is read from the tensors and time spans."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    head = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    schema = f"doc_id {kind}, {_STORED.partition(', frames')[0]}, feature string"
    return stored.select(*head, "frames", "segments", "tensors").mapInArrow(released(_described), schema)
