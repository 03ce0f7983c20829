"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

A text's segmentations are the paths through the lattice of pieces that match it. Their weights
are the products of exp(THETA * score) of the pieces; forward filtering sums them up to every place,
backward sampling then draws a path piece by piece from the end. No piece reaches over the beginning
of a word, so words are filtered one by one, equal words of a batch together, and drawn for each
occurrence by a counter-based generator that takes the row's key and the place in the text: the
same row gives the same path whatever else is in the batch or the partition.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeparts.llm.common import parts, worker_cache

SPACE = "▁"
#: Scores of a merge-ordered vocabulary are minus the rank of the merge; a rank's weight is 1 / (rank + 1) ** THETA.
THETA = 1.0
#: Logarithm of the weight of a byte, for characters that no piece has.
BYTE = -30.0
SEED = 42
#: Characters that are sampled together, and words whose lattices a worker keeps.
CHUNK, KEPT_WORDS = 1 << 18, 400_000
#: Longer words are filtered by themselves; so few occurrences are drawn one by one.
LONG_WORD, FEW = 256, 4

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
C = np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a model file, with a hash table of their characters."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [
            i for i, p in enumerate(self.pieces)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and SPACE not in p[1:]
        ]
        self.byte = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
        self.written = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte.tolist()):
            self.written[i] = bytes([b])
        self.lattice: Lattice | None = None
        self.lines = not any("\n" in self.pieces[i][1:] or "\n" in self.pieces[i][:-1] for i in plain)
        self.longest = max(len(self.pieces[i]) for i in plain)
        scores = np.array([model.get_score(i) for i in plain])
        ranked = bool((scores <= 0).all() and (scores == np.round(scores)).all() and len(set(scores.tolist())) == len(scores))
        weight = -theta * np.log1p(-scores) if ranked else theta * scores
        keys = np.array([self._key(self.pieces[i]) for i in plain], dtype=np.uint64)
        bits = int(np.ceil(np.log2(len(plain)))) + 3
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.tag = np.zeros(1 << bits, dtype=np.uint64)
        self.id = np.full(1 << bits, -1, dtype=np.int32)
        self.weight = np.full(1 << bits, -np.inf)
        self.probes = 1
        for key, i, w in zip(keys, plain, weight, strict=True):
            slot, probe = int(key >> self.shift), 1
            while self.id[slot] >= 0:
                slot, probe = (slot + 1) & self.mask, probe + 1
            self.tag[slot], self.id[slot], self.weight[slot] = key, i, w
            self.probes = max(self.probes, probe)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(A) + int(_mixed(np.array([ord(c) + 1], dtype=np.uint64))[0])) % (1 << 64)
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no piece has it."""
        slot = (keys >> self.shift).astype(np.int64)
        found = np.where(self.tag[slot] == keys, slot, -1)
        open_ = np.flatnonzero((found < 0) & (self.id[slot] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.tag[slot[open_]] == keys[open_]
            found[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (self.id[slot[open_]] >= 0)]
        return found


def words_of(text: str, lines: bool = False) -> list[str]:
    """The text with its spaces as marks and one before it, cut before each mark; a mark in the text itself is kept apart.

    With ``lines`` it is cut around line ends as well, which holds where no piece has one among others.
    Joined again, the words give the text.
    """
    if not lines or "\n" not in text or SPACE in text:
        return [SPACE + w for w in text.split(" ")]
    first, *others = text.split("\n")
    words = [SPACE + w for w in first.split(" ")]
    for line in others:
        words.append("\n")
        start, *rest = line.split(" ")
        if start:
            words.append(start)
        words += [SPACE + w for w in rest]
    return words


class _Names(dict):
    """Numbers of words; ``new`` has those that were asked for first since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class _Grown:
    """An array that is appended to."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1 << 12, dtype=kind), 0

    def append(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(self.n // 4 + 2 * len(x), dtype=self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Lattice:
    """Forward-filtered lattices of different words: what backward sampling needs at every place.

    All that is kept of a word follows from the word alone, to the last bit, so it can be kept from
    batch to batch or made again.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.names = vocabulary, _Names()
        self.end, self.first = _Grown(np.int64), _Grown(np.int64)  # last place of each word; first edge that ends at each place
        self.place, self.codes = _Grown(np.int32), _Grown(np.uint32)
        self.size, self.id, self.sum = _Grown(np.int16), _Grown(np.int32), _Grown(np.float64)  # of the edges

    def numbers(self, words: list[str]) -> np.ndarray:
        numbers = np.fromiter(map(self.names.__getitem__, words), dtype=np.int64, count=len(words))
        if self.names.new:
            self._add(self.names.new)
            self.names.new = []
        return numbers

    def _add(self, words: list[str]) -> None:
        v, places, edges = self.vocabulary, self.place.n, self.size.n
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = len(codes)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(n) - starts[word]  # of a character in its word
        value = _mixed(codes.astype(np.uint64) + np.uint64(1))
        literal = (codes == ord(SPACE)) & (place > 0)  # a mark that is in the text is no space
        bad = np.cumsum(literal)
        rolling, found = np.zeros(n, dtype=np.uint64), []
        for size in range(1, v.longest + 1):
            at = np.flatnonzero(place >= size - 1)
            if not len(at):
                break
            if size == 1:
                rolling = value.copy()
            else:  # key of the `size` characters that end here
                rolling = np.concatenate([np.zeros(1, np.uint64), rolling[:-1]]) * A + value
            slot = v.find(rolling[at])
            whole = bad[at] == np.where(at >= size, bad[at - size], 0)  # without a mark of the text
            ok = (slot >= 0) & whole
            found.append((at[ok], np.full(int(ok.sum()), size, dtype=np.int64), slot[ok]))
        end, size, slot = (np.concatenate(x) for x in zip(*reversed(found), strict=True))  # the longest first: the likeliest, mostly
        single = np.zeros(n, dtype=bool)
        single[end[size == 1]] = True
        missing = np.flatnonzero(~single)  # characters that no piece has: their bytes
        bytes_ = 1 + (codes[missing] > 0x7F) + (codes[missing] > 0x7FF) + (codes[missing] > 0xFFFF)
        end = np.concatenate([end, missing])
        size = np.concatenate([size, np.ones(len(missing), np.int64)])
        ids = np.concatenate([v.id[slot], np.full(len(missing), -1, np.int32)])
        weight = np.concatenate([v.weight[slot], BYTE * bytes_])
        order = np.argsort(end, kind="stable")
        end, size, ids, weight = end[order], size[order], ids[order], weight[order]
        first = np.searchsorted(end, np.arange(n + 1))  # edges that end at a place
        score, total = self._filtered(sizes, place, end, size, weight, first)
        chance = np.exp(score - total[end])
        rank = np.arange(len(end)) - first[end]
        summed = chance.copy()  # over the edges of the place, one after another
        for r in range(1, int(rank.max(initial=0)) + 1):
            e = np.flatnonzero(rank == r)
            summed[e] = summed[e - 1] + chance[e]
        summed[first[1:] - 1] = 2.0  # the last one takes what rounding leaves
        for grown, x in (
            (self.end, ends - 1 + places), (self.first, first[:-1] + edges), (self.place, place), (self.codes, codes),
            (self.size, size), (self.id, ids), (self.sum, summed),
        ):
            grown.append(x)

    @staticmethod
    def _filtered(sizes, place, end, size, weight, first) -> tuple[np.ndarray, np.ndarray]:
        """(score, total): logarithms of the sum of the paths that end with each edge, and at each place.

        Words are filtered together, place by place, and long ones by themselves.
        """
        score, total = np.empty(len(end)), np.empty(len(place))
        long = np.repeat(sizes > LONG_WORD, sizes)
        level = np.where(long[end], -1, place[end])
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_level[a:b]
            before = end[e] - size[e]
            s = score[e] = weight[e] + np.where(size[e] <= place[end[e]], total[before], 0.0)
            starts = np.flatnonzero(np.r_[True, end[e][1:] != end[e][:-1]])
            most = np.maximum.reduceat(s, starts)
            sums = np.add.reduceat(np.exp(s - np.repeat(most, np.diff(np.r_[starts, len(s)]))), starts)
            total[end[e][starts]] = most + np.log(sums)
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            at = int(sizes[:i].sum())
            sums = [0.0]
            lists = (x[first[at] : first[at + int(sizes[i])]].tolist() for x in (end, size, weight))
            now, found = at, []
            for e, (to, k, w) in enumerate(zip(*lists, strict=True), int(first[at])):
                if to != now:
                    sums.append(_log_sum(found))
                    now, found = to, []
                found.append(w + sums[to - at + 1 - k])
                score[e] = found[-1]
            sums.append(_log_sum(found))
            total[at : at + int(sizes[i])] = sums[1:]
        return score, total

    def sample(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edge, pieces): the edges drawn for occurrences of words, in the order of the text, and their number for each.

        ``key`` gives each occurrence its own random numbers.
        """
        first, sums, size, place = self.first.all, self.sum.all, self.size.all, self.place.all
        at, live, out, step = self.end.all[word], np.arange(len(word)), [], 0
        number = np.zeros(len(word), dtype=np.int64)
        while len(live) > FEW:
            u = (_mixed(key[live] + np.uint64(step * int(A) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[at]
            on = np.flatnonzero(u >= sums[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= sums[edge[on]]]
            out.append((live, edge))
            number[live] += 1
            more = np.flatnonzero(place[at] >= size[edge])
            at = (at - size[edge])[more]
            live, step = live[more], step + 1
        for i, last in zip(live.tolist(), at.tolist(), strict=True):  # few are left, or long: one by one
            start, k, drawn = last - int(place[last]), step, []
            while last >= start:
                some = np.arange(k, k + 64, dtype=np.uint64) * A + key[i]
                for u in ((_mixed(some) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist():
                    edge = int(first[last])
                    while u >= sums[edge]:
                        edge += 1
                    drawn.append(edge)
                    last -= int(size[edge])
                    if last < start:
                        break
                k += 64
            number[i] += len(drawn)
            out.append((np.full(len(drawn), i), np.array(drawn, dtype=np.int64)))
        edges = np.empty(int(number.sum()), dtype=np.int64)
        to = np.cumsum(number)
        for where, drawn in out:  # from the end of each word on
            if len(where) and where[0] == where[-1]:
                to[where[0]] -= len(drawn)
                edges[to[where[0]] : to[where[0]] + len(drawn)] = drawn[::-1]
            else:
                to[where] -= 1
                edges[to[where]] = drawn
        return edges, number


def _log_sum(x: list[float]) -> float:
    most = max(x)
    return most + math.log(sum(math.exp(y - most) for y in x))


def encode_batch(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
    """Ids of a sampled segmentation of each text; ``keys`` are the rows' 64-bit keys."""
    if vocabulary.lattice is None or len(vocabulary.lattice.names) > KEPT_WORDS:
        vocabulary.lattice = Lattice(vocabulary)
    lattice, words = vocabulary.lattice, [words_of(t, vocabulary.lines) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = _mixed(keys.astype(np.uint64) + np.uint64(seed * int(B) % (1 << 64)))
    key = _mixed(own[row] + nth.astype(np.uint64) * C)
    edge, number = lattice.sample(lattice.numbers([w for ws in words for w in ws]), key)
    ids, row_of = lattice.id.all[edge], np.repeat(row, number)
    if (ids < 0).any():  # characters as bytes
        bad = np.flatnonzero(ids < 0)
        end = np.searchsorted(lattice.first.all, edge[bad], side="right") - 1  # the place that the edge ends at
        bytes_ = [vocabulary.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in lattice.codes.all[end].tolist()]
        times = np.ones(len(ids), dtype=np.int64)
        times[bad] = [len(b) for b in bytes_]
        spread = np.repeat(ids, times)
        spread[spread < 0] = np.concatenate(bytes_)
        ids, row_of = spread, np.repeat(row_of, times)
    return np.split(ids, np.searchsorted(row_of, np.arange(1, len(texts))))


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text that the ids were drawn for: marks of pieces are spaces, bytes are themselves."""
    return b"".join(map(vocabulary.written.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def _vocabulary(path: str) -> Vocabulary:
    cache = worker_cache("pieces")
    return cache.get(path) or cache.setdefault(path, Vocabulary(path))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) of every row; what is drawn for a row follows from its key."""
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text)
    return docs.select(F.col("doc_id").cast("long"), key.alias("key"), text.alias("text"))


def _drawn(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Parts of the batches of (doc_id, key, text), with their texts and drawn ids."""
    for batch in batches:
        for part, texts in parts(batch, 2, CHUNK):
            yield part, texts, encode_batch(vocabulary, texts, part.column(1).to_numpy().view(np.uint64), seed)


def encoded(docs: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text, any others): the ids of a segmentation drawn for the row.

    The draw depends on doc_id, text and seed alone, so it is the same wherever and whenever it is
    made; rows that are given twice are segmented alike. A null text is an empty one, whose only piece
    is the mark of the space before it. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids in _drawn(_vocabulary(path), batches, seed):
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return _keyed(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in batches:
            texts = [decode(vocabulary, i.values.to_numpy()) if i.is_valid else None for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_sha256, lossless) for every row of ``docs``: its drawn ids, and whether they decode to its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for part, texts, ids in _drawn(vocabulary, batches, seed):
            columns = [
                pa.array([len(t) for t in texts], pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([decode(vocabulary, i) == t for t, i in zip(texts, ids, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_chars", "n_pieces", "ids_sha256", "lossless"])

    return _keyed(docs).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_sha256 string, lossless boolean")
