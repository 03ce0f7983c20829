"""Audio columns: bytes as 8-bit samples in WAV files, and their features as fixed-shape tensors with time spans.

The samples are resampled by a polyphase filter, cut into overlapping frames, and turned into log-mel
energies; a threshold with hysteresis finds the loud segments. Features are stored as an Arrow
stream whose columns are a tensor of fixed shape and the time span that it covers.
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

from rangeparts.llm.common import parts

#: Payloads are padded with zeros to a positive multiple of so many bytes.
UNIT = 64
RATE = 12_000
#: Resampling by UP / DOWN, to 8,000 samples a second, with TAPS taps of the filter for each output.
UP, DOWN, TAPS = 2, 3, 24
FRAME, HOP, MELS = 256, 128, 24
#: Frames of a tensor.
PATCH = 64
#: Decibels over the median at which a segment begins, and under which it ends.
RISE, FALL = 6.0, 3.0
#: Output samples that are computed at once; a multiple of HOP.
BLOCK = HOP * 1024
#: Characters of texts that are worked on together.
CHUNK = 1 << 20


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, padded, and its length before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; their number is even, as chunks have to be."""
    size = len(samples)
    return b"".join((
        b"RIFF", struct.pack("<I", (36 + size) & 0xFFFFFFFF), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8),
        b"data", struct.pack("<I", size & 0xFFFFFFFF), samples,
    ))


def samples_of(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAV file as ``wav`` writes it, and their rate; ValueError for any other bytes."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAV file")
    size, kind, channels, rate, _, _, bits = struct.unpack("<IHHIIHH", media[16:36])
    if (size, kind, channels, bits) != (16, 1, 1, 8) or media[36:40] != b"data":
        raise ValueError("not mono 8-bit PCM")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]], rate


def _taps(up: int, down: int, taps: int) -> np.ndarray:
    """(up, taps): for each phase a low-pass filter, a windowed sinc, whose taps sum up to one.

    The tap j of a phase weighs the sample j - taps / 2 after the one at or before the output.
    """
    t = np.arange(up)[:, None] / up - (np.arange(taps) - taps // 2)  # samples from each one to the output
    h = np.sinc(t * min(1.0, up / down)) * (0.54 + 0.46 * np.cos(2 * np.pi * t / (taps + 2)))
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


_FILTER = _taps(UP, DOWN, TAPS)


def resampled(x: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` samples from ``first`` on of ``x`` at UP / DOWN of its rate; beyond its ends there is silence."""
    places = np.arange(first, first + count) * DOWN
    base, phase = places // UP, places % UP
    begin = int(base[0]) - TAPS // 2
    end = int(base[-1]) + TAPS - TAPS // 2
    part = np.zeros(end - begin, dtype=np.float32)
    low, high = max(begin, 0), min(end, len(x))
    if high > low:
        part[low - begin : high - begin] = x[low:high]
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(count, dtype=np.float32)
    for p in range(UP):  # the outputs of a phase share its filter
        at = np.flatnonzero(phase == p)
        out[at] = windows[base[at] - begin - TAPS // 2] @ _FILTER[p]
    return out


def _mel_bands(rate: float) -> np.ndarray:
    """(FRAME / 2 + 1, MELS): triangles that are evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1) / (rate / FRAME)
    bins = np.arange(FRAME // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_BANDS = _mel_bands(RATE * UP / DOWN)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(samples: bytes) -> np.ndarray:
    """(frames, MELS): log-mel energies in decibels, of frames around every HOP; beyond its ends a sound is silent."""
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    n = -(-len(x) * UP // DOWN)
    frames = 1 + n // HOP
    out = []
    for at in range(0, frames, BLOCK // HOP):
        k = min(BLOCK // HOP, frames - at)
        y = resampled(x, at * HOP - FRAME // 2, (k - 1) * HOP + FRAME)
        y = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * _WINDOW
        power = np.abs(np.fft.rfft(y, axis=1)).astype(np.float32) ** 2
        out.append(10 * np.log10(power @ _BANDS + 1e-6))
    return np.concatenate(out).astype(np.float32)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of frames that rise RISE over the median energy, until they fall under FALL over it."""
    energy = mel.mean(axis=1)
    over = energy - np.median(energy)
    # the state after each frame is that of the last frame that decided: loud or quiet
    decided = np.where(over >= RISE, 1, np.where(over < FALL, 0, -1))
    last = np.maximum.accumulate(np.where(decided >= 0, np.arange(len(over)), -1))
    loud = np.where(last >= 0, decided[last], 0)
    edges = np.flatnonzero(np.diff(np.r_[0, loud, 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS])
FEATURES = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("loud_frames", pa.int32()), ("log_mel", TENSOR)])


def features(samples: bytes) -> pa.RecordBatch:
    """One row for each PATCH frames: its time span, how many of its frames are in loud segments, and its log-mel
    tensor. The last tensor is filled up with the lowest energy; the span covers its own frames only.
    """
    mel = log_mel(samples)
    loud = np.zeros(len(mel), dtype=np.int32)
    for first, end in segments(mel):
        loud[first:end] = 1
    n = -(-len(mel) // PATCH)
    full = np.full((n * PATCH, MELS), -60.0, dtype=np.float32)
    full[: len(mel)] = np.round(mel, 2)
    second = HOP * DOWN / UP / RATE
    starts = np.arange(n) * PATCH
    ends = np.minimum((starts + PATCH) * second, len(samples) / RATE)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.minimum(starts * second, ends)),
            pa.array(ends),
            pa.array(np.add.reduceat(loud, starts).astype(np.int32)),
            pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, MELS)),
        ],
        schema=FEATURES,
    )


def stored(batch: pa.RecordBatch) -> bytes:
    """The features as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a WAV file; a null text is an empty one, 64 zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch, 1, CHUNK):
                made = [payload(t) for t in texts]
                media = pa.array([wav(p) for p, _ in made], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([n for _, n in made], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature_column(media: DataFrame) -> DataFrame:
    """``media`` with a column ``features``: of each WAV file, the Arrow stream of ``features``. A null file gives null."""
    names = media.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, files in parts(batch, names.index("media"), CHUNK):
                made = pa.array([stored(features(samples_of(m)[0])) if m else None for m in files], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, made], [*names, "features"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, schema + ", features binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    """What the file of a text gives back, and its features, read back too: DIGEST without the id."""
    made, n = payload(text)
    media = wav(made)
    back, _ = samples_of(media)
    data = stored(features(back))
    table = read(data)
    feature = f"{table.num_rows}:{sum(table['loud_frames'].to_pylist())}:{table['end_s'][-1].as_py():.3f}:{hashlib.sha256(data).hexdigest()}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any others): what the stored file gives back, and its features.

    ``feature`` has the numbers of tensors and loud frames, the end of the last span, and the SHA-256 of
    the stored features. Equal texts have equal values; a null text is an empty one. No rows give no
    rows. Files and features are those of ``media_column`` and ``feature_column``, but are let go text by text.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch, 1, CHUNK):
                columns = zip(*map(digest, texts), strict=True)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)
