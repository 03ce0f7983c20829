"""Packing of tokenised documents into sequences of bounded length, by linear grouping and best fit.

What is packed are pieces, and a piece's place depends on its length and on its rank among those of
the same length alone. So the packing is worked out from the counts by length, of which there are no
more than the capacity, whatever the corpus; its result is a list of runs, each a filling that is
used a number of times. The pieces then find their places by rank, in parallel.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeparts.llm.common import cut, parts, worker_cache

CAPACITY = 1024
END_ID = 2
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 128
#: Lengths over the capacity / LARGE are large.
LARGE = 8
#: The linear programme is within this factor of its optimum.
NEAR_BEST = 1.0005
#: Pieces that are ranked by one task, about.
RANKED = 50_000
#: Words whose ids a worker keeps, of those at the beginning of a line and of the others.
KEPT_WORDS = 200_000
#: Characters of texts that are encoded together.
CHUNK = 1 << 20


# -- tokens ------------------------------------------------------------------------------------


class _Known(dict):
    """Ids of the parts that have been seen, each with the same text before it; the others are encoded."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        self.encode, self.before = encode, before

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[part] = self.encode(self.before + part)
        return ids


class Encoder:
    """Ids of a text under a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    The ids are those of the ``tokenizers`` library for the whole text. A text is cut at single
    spaces and line ends between other characters, where that vocabulary's pattern always cuts, and
    the ids of the parts are kept. Parts of Latin letters, digits and ASCII signs are encoded with the
    same merges by ``tiktoken``, which takes a third of the time; all others by ``tokenizers``, as the
    libraries may know different versions of the character classes. A text with the string of an added
    token, such as <|endoftext|>, goes to ``tokenizers`` whole, which takes it for that token.
    """

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.first, self.later = _Known(self._ids, ""), _Known(self._ids, " ")
        self.latin = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ]*").fullmatch
        self.other_blanks = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec["model"], set(self.added))
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as this machine has them: little-endian, 32 bits")
        self.line_end = self._ids("\n")

    @staticmethod
    def _fast(model: dict, special: set[str]):
        """A tiktoken encoding of the same vocabulary; None if its ids don't follow the order of its merges."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, part: str) -> bytes:
        if self.fast is not None and self.latin(part):
            return array("I", self.fast.encode_ordinary(part)).tobytes()
        return self._whole(part)

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bool:
        """Whether all white space is single spaces and line ends between other characters."""
        if text[:1].isspace() or text[-1:].isspace() or self.other_blanks(text):
            return False
        return not any(run in text for run in ("  ", " \n", "\n ", "\n\n"))

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self._whole(text)
        if not self._plain(text):  # runs of white space are cut by other rules
            return self._ids(text)
        out, first, later = [], self.first.__getitem__, self.later.__getitem__
        for line in text.split("\n"):
            parts = line.split(" ")
            out.append(self.line_end)
            out.append(first(parts[0]))
            out += map(later, parts[1:])
        return b"".join(out[1:])


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first are as long as the capacity."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((at, capacity) for at in range(first, length, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_batches(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("packing")
        encoder = cache.get(path) or cache.setdefault(path, Encoder(path))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for rows, texts in parts(batch, 1, CHUNK):
                columns = [[] for _ in range(6)]
                for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                    ids = encoder.encode(text) + end
                    for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        row = (doc_id, piece, start, length, zlib.crc32(part), np.frombuffer(part, dtype="<i4") if with_ids else None)
                        for c, v in zip(columns, row, strict=True):
                            c.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return run


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all ``docs``; a null text is one piece with ``end_id`` alone. With ids, as an array, if asked."""
    run = _piece_batches(path, end_id, capacity, with_ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


# -- the packing -------------------------------------------------------------------------------


def _best_filling(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The filling of the capacity with the highest sum of prices, and that sum; places in ``sizes``."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = sizes <= c
        worth = np.where(fits, best[np.maximum(c - sizes, 0)] + prices, 0.0)
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], last[c] = worth[k], k
        else:
            best[c] = best[c - 1]
    filling, c = [], capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            filling.append(int(last[c]))
            c -= int(sizes[last[c]])
    return float(best[capacity]), sorted(filling)


def _few_sizes(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times): fillings of the capacity by a few sizes, as few as a linear programme gives.

    A configuration is a tuple of places in ``sizes``. The programme, to cover all counts with the
    least number of fillings, is solved by the simplex method, which gets its columns from a knapsack
    until none is worth more than NEAR_BEST. Times are rounded down, so some of the counts are left.
    """
    if not sizes:
        return []
    each = np.array(sizes)
    columns = [[i] * (capacity // n) for i, n in enumerate(sizes)]
    b = np.diag([float(len(c)) for c in columns])
    need = np.array(counts, dtype=float)
    for _ in range(40 * len(sizes)):
        worth, filling = _best_filling(each, np.linalg.solve(b.T, np.ones(len(sizes))), capacity)
        if worth <= NEAR_BEST:
            break
        column = np.bincount(filling, minlength=len(sizes)).astype(float)
        x, step = np.linalg.solve(b, need), np.linalg.solve(b, column)
        leave = int(np.argmin(np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)))
        columns[leave], b[:, leave] = filling, column
    left, out = list(counts), []
    for filling, times in zip(columns, np.linalg.solve(b, need), strict=True):
        times = min([int(times + 1e-6), *(left[i] // filling.count(i) for i in set(filling))])
        if times > 0:
            out.append((tuple(filling), times))
            for i in filling:
                left[i] -= times
    return out


def pack(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): how often a sequence is filled by these lengths, for so many pieces of each length.

    Lengths over an eighth of the capacity are sorted and cut into ``groups`` groups of equal
    cardinality; each is rounded up to the largest of its group; the few sizes that this leaves are
    packed by configurations. The pieces then take the places of their group in order of length. The
    room that rounding left is given to the shorter pieces, and to those that rounding times down has
    left over, longest first and where they fit best.
    """
    runs: list[tuple[tuple[int, ...], int]] = []
    counts = {n: c for n, c in counts.items() if c > 0}
    if full := counts.pop(capacity, 0):
        runs.append(((capacity,), full))
    large = sorted((n for n in counts if LARGE * n > capacity), reverse=True)
    total = sum(counts[n] for n in large)
    queues: list[list[list[int]]] = []  # of each group: [length, count] from the longest on
    seen = 0
    for n in large:
        left = counts[n]
        while left:
            group = seen * groups // total
            if group >= len(queues):
                queues.append([])
            take = min(left, -(-(group + 1) * total // groups) - seen)
            queues[-1].append([n, take])
            seen += take
            left -= take
    sizes = [q[0][0] for q in queues]
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(filling: tuple[int, ...], times: int) -> None:
        room[capacity - sum(filling)].append((filling, times))

    for configuration, times in _few_sizes(sizes, [sum(c for _, c in q) for q in queues], capacity):
        slots = []
        for i in configuration:
            got, need = [], times
            while need:
                take = min(need, queues[i][0][1])
                got.append([queues[i][0][0], take])
                queues[i][0][1] -= take
                need -= take
                if not queues[i][0][1]:
                    queues[i].pop(0)
            slots.append(got)
        while slots[0]:
            run = min(s[0][1] for s in slots)
            put(tuple(s[0][0] for s in slots), run)
            for s in slots:
                s[0][1] -= run
                if not s[0][1]:
                    s.pop(0)
    rest = {n: c for n, c in counts.items() if LARGE * n <= capacity}
    for n, c in (x for q in queues for x in q):
        rest[n] = rest.get(n, 0) + c
    for n in sorted(rest, reverse=True):
        left = rest[n]
        rooms = sorted(r for r in room if room[r])
        at = bisect_left(rooms, n)
        while left:
            if at < len(rooms):
                r = rooms[at]
                filling, times = room[r].pop()
                if not room[r]:
                    at += 1
            else:
                r, filling = capacity, ()
                times = -(-left // (capacity // n))
            each = r // n
            whole = min(times, left // each)
            if whole:
                put(filling + (n,) * each, whole)
                left -= whole * each
            if whole < times:
                if left:  # fewer than one sequence can take
                    put(filling + (n,) * left, 1)
                    left, whole = 0, whole + 1
                if whole < times:
                    room[r].append((filling, times - whole))
    return runs + [x for r in sorted(room) for x in room[r]]


def places(runs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from the first on take the sequences from the first on."""
    rows, taken, sequence = [], defaultdict(int), 0
    for filling, times in runs:
        offset = 0
        for n in filling:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the rank of each among those of its length, from 0.

    A length may have a large part of all rows, so ranks are counted in parts that the ids are dealt
    to, and the sums of the parts before are added.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, n // RANKED + 1))))
    key = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    sums = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(key) - 1).join(sums, ["length", "part"])
    return ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def packed(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text, any others) with their sequence and their offset in it.

    (doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset). Only documents longer than
    the capacity are cut. A null or empty text is one piece, the end id. Repeated rows, ties and
    rows without an id are packed like any other. No rows give no rows.
    """
    rows = cut(pieces(docs, path, end_id, capacity, with_ids))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = rows.sparkSession.sparkContext.broadcast(places(pack(counts, capacity)))
    ranked = _ranked(rows, sum(counts.values()))
    names = [*rows.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        first = known[:, 0] << 44 | known[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(first, length << 44 | rank, side="right") - 1
            kept = [batch.column(batch.schema.names.index(c)) for c in names[:-2]]
            found = [pa.array(known[at, 2] + rank - known[at, 1]), pa.array(known[at, 3])]
            yield pa.RecordBatch.from_arrays([*kept, *found], names)

    schema = PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*rows.columns, "rank").mapInArrow(run, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts) of packed rows with ids: the sequences themselves, each a bounded group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts")
    )
