"""Winnowing fingerprints: of each window of k-gram hashes the least, the rightmost of equal ones, with its position.

Two texts that share GRAM + WINDOW - 1 bytes share a fingerprint hash, and what is shorter than GRAM
bytes is never matched but as a whole text. Both are small, so that a text of a few words has several
hashes, and a near copy of it some of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeparts.llm.common import parts

#: Bytes of a gram, a power of two, and grams of a window.
GRAM, WINDOW = 8, 8
#: Grams that are hashed at once.
BLOCK = 1 << 20
#: Characters of texts, or of fingerprints, that are given together.
CHUNK = 1 << 22
MULTIPLIER = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1

_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype="<u8")


def _gram_keys(data: np.ndarray, start: int, gram: int) -> np.ndarray:
    """For each gram of ``data``: its 32-bit hash above its position from the end of 32 bits, so that of equal hashes the rightmost is least."""
    h, width, power = _BYTES[data], 1, MULTIPLIER
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % (1 << 64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    place = np.uint64(0xFFFFFFFF) - np.arange(start, start + len(h), dtype=np.uint64)
    return (h & np.uint64(0xFFFFFFFF00000000)) | place


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of each window."""
    width = 1
    while 2 * width <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return np.minimum(keys[: len(keys) - (window - width)], keys[window - width :]) if width < window else keys


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """(hash, position) of the chosen grams in their order, as an array (n, 2) of 32-bit numbers; a position is a byte."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros((0, 2), dtype=np.uint32)
    if len(data) < gram:
        whole = int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=4).digest(), "big")
        return np.array([[whole, 0]], dtype=np.uint32)
    grams, chosen = len(data) - gram + 1, []
    window = min(window, grams)
    for at in range(0, grams - window + 1, BLOCK):
        keys = _gram_keys(data[at : min(len(data), at + BLOCK + window + gram - 2)], at, gram)
        least = _least(keys, window)
        chosen.append(least[np.r_[True, least[1:] != least[:-1]]])
    keys = np.concatenate(chosen)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return np.stack([keys >> np.uint64(32), np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))], axis=1).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the hashes of two fingerprints; 1 if both are empty."""
    x, y = np.unique(a[:, 0]), np.unique(b[:, 0])
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def written(prints: np.ndarray) -> str:
    """Sixteen hexadecimal digits for each chosen gram: hash and position."""
    return prints.astype(">u4").tobytes().hex()


def read(prints: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(prints), dtype=">u4").reshape(-1, 2).astype(np.uint32)


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs``; a null text has the empty fingerprint that an empty one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch, 1, CHUNK):
                prints = [written(fingerprint(t, gram, window)) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, ghost, id, text): rows dealt to ranges of ids, each range followed by the first row of the next one as a ghost.

    The bounds of the ranges are ids that occur, so the first rows of a range are those at its bound.
    Only the ids are sorted out by Python; the texts are shuffled once.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    lowest, bounds = rows.agg(F.min("id"), F.percentile_approx("id", shares, 100 * ranges)).first()
    bounds = np.unique([b for b in bounds or [] if b > lowest]).astype(np.int64) if ranges > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("array<int>")
    def dealt(ids):
        import pandas as pd

        x = ids.to_numpy()
        part = np.searchsorted(bounds, x, side="right")
        ghost = np.searchsorted(bounds, x, side="left")  # less by one where the id is a bound
        ghost[x == lowest] = len(bounds)
        first = (ghost < part) | (x == lowest)
        return pd.Series([[p, g] if f else [p] for p, g, f in zip(part.tolist(), ghost.tolist(), first.tolist(), strict=True)])

    spread = rows.select("id", "text", F.posexplode(dealt("id")).alias("ghost", "part"))
    dealt_rows = spread.repartitionById(len(bounds) + 1, "part")
    return dealt_rows.select("part", "ghost", "id", "text").sortWithinPartitions("part", "ghost", "id", F.xxhash64("text"))


def compared(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The next row is the one that follows by doc_id, then by a hash of the text; rows without an id
    come last, and after the last row comes the first. A single row is its own next. A null text is
    an empty one; likenesses are 1 where both fingerprints are empty. No rows give no rows.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc_id: int, text: str, prints: np.ndarray, following: str, next_prints: np.ndarray) -> tuple:
        edited = edited_text(text, following)
        edited_prints = prints if edited == text else fingerprint(edited, gram, window)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (
            None if doc_id == LAST else doc_id, len(text), digest, written(prints), written(edited_prints),
            likeness(prints, edited_prints), likeness(prints, next_prints),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (part, id, text, fingerprint) of a row whose next one has not come yet

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            out, size = [], 0
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for (part, ghost, doc_id), value in zip(keys, batch.column(3), strict=True):
                if ghost and before is None:
                    continue
                text = value.as_py()
                prints = fingerprint(text, gram, window)
                if before is not None and before[0] == part:
                    out.append(row(*before[1:], text, prints))
                    size += len(out[-1][3]) + len(out[-1][4])
                    if size >= CHUNK:
                        yield given()
                        out, size = [], 0
                before = None if ghost else (part, doc_id, text, prints)
            if out:
                yield given()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, ranges).mapInArrow(run, schema)
