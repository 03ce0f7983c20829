"""Toxicity: class-conditional Kneser-Ney models of the characters inside words.

Each class has discounted counts of its own at the highest order; both back off to one interpolated
Kneser-Ney model that is counted over the whole corpus. An expression that a class has not seen, or
hardly, therefore gets nearly the same likelihood from both. A document is judged by one number, the
ratio of the two likelihoods normalised by length: the mean logarithm of the ratio over the fiftieth
of its words that speaks most for the toxic class. Over all of the words, a few toxic ones in a long
text would be lost in the noise of the others. The score is that number, calibrated by a logistic
curve on texts that the models have not seen.
"""

from __future__ import annotations

import io
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeparts.llm.common import cut, fold, parts, training_rows, worker_cache

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
#: Labelled rows that the class models are fitted on, at most. The shared counts are of all rows.
SAMPLE = 16_384
ORDER = 5
#: What an n-gram's count is lowered by in the shared model.
DISCOUNT = 0.75
#: Characters that are thought possible: 2 ** this. Unicode has some 160,000.
SHARED_SLOTS = 18
#: A word's ratio counts as MOST at most; a text is judged by its words' highest SHARE-th, one word at least.
MOST, SHARE = 6.0, 50
#: Characters of texts that are read together, words whose n-grams are counted together, and words whose ratios are kept.
CHUNK, WORDS, KEPT_WORDS = 1 << 20, 50_000, 150_000

WORD = re.compile(r"[^\W_]+")
BEGIN, END = 2, 3
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(32))) * MIX


class _Grams:
    """Hashes of the n-grams of many words, each as begin mark, characters, end mark, one after another."""

    def __init__(self, words: list[str]):
        joined = chr(END) + "".join(f"{chr(BEGIN)}{w}{chr(END)}" for w in words)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[1:].astype(np.uint64)
        begins = np.flatnonzero(self.codes == BEGIN)
        self.word = np.cumsum(self.codes == BEGIN) - 1
        self.place = np.arange(len(self.codes)) - begins[self.word] if len(words) else np.zeros(0, np.int64)
        value = _mixed(self.codes + np.uint64(1))
        self.rolling = [value]
        for _ in range(1, ORDER):
            before = np.concatenate([np.zeros(1, np.uint64), self.rolling[-1][:-1]])
            self.rolling.append(before * BASE + value)

    def key(self, n: int) -> np.ndarray:
        """Of the n characters that end at each place."""
        return _mixed(self.rolling[n - 1] + np.uint64(n))

    def context(self, n: int) -> np.ndarray:
        """Key of the n - 1 characters before each place."""
        return np.concatenate([np.zeros(1, np.uint64), self.key(n - 1)[:-1]])[: len(self.codes)]

    def known(self, n: int) -> np.ndarray:
        """Places whose n characters are inside one word; the begin mark itself is never predicted."""
        return (self.place >= n - 1) & (self.place >= 1)


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted ``known`` ones, -1 where it has none."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


class ByOrder(list):
    """A value for each key, by order; ``keys`` has the sorted keys, ``missing`` the value of any other one."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray], missing: list[float]):
        super().__init__(values)
        self.keys, self.missing = keys, missing

    def of(self, n: int, keys: np.ndarray) -> np.ndarray:
        at = _find(self.keys[n], keys)
        out = np.full(len(keys), self.missing[n], dtype=np.float64)
        out[at >= 0] = self[n][at[at >= 0]]
        return out


def _by_order(shares: list[tuple], rests: list[tuple], characters: tuple[np.ndarray, np.ndarray]) -> tuple[ByOrder, ByOrder]:
    """Shares and rests from (keys, values) by order, from 0, and how many characters each single one follows."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    keys, followed = characters
    whole = followed.sum() + 0.5 * (1 << SHARED_SLOTS)
    shares = [none, (keys, ((followed + 0.5) / whole).astype(np.float32)), *shares[2:]]
    share = ByOrder([k for k, _ in shares], [v for _, v in shares], [0.0, 0.5 / whole] + [0.0] * (ORDER - 1))
    rests = [none, none, *rests[2:]]
    return share, ByOrder([k for k, _ in rests], [v for _, v in rests], [1.0] * (ORDER + 1))


def _rows_of(words: list[str], times: np.ndarray) -> Iterator[tuple]:
    """(n, keys, contexts, suffixes, begins, times) of the different n-grams of some words, for each order; keys are sorted."""
    grams = _Grams(words)
    for n in range(2, ORDER + 1):
        at = np.flatnonzero(grams.known(n))
        keys, where, back = np.unique(grams.key(n)[at], return_index=True, return_inverse=True)
        first = at[where]
        summed = np.bincount(back, weights=times[grams.word[at]], minlength=len(keys)).astype(np.int64)
        yield n, keys, grams.context(n)[first], grams.key(n - 1)[first], grams.place[first] == n - 1, summed


class Shared:
    """Counts of the n-grams of the words that are added, held in memory; ``shared_model`` does the same for a corpus."""

    def __init__(self):
        self.words: Counter = Counter()
        self.times, self.context = ([np.zeros(0, np.int64) for _ in range(ORDER + 1)] for _ in range(2))

    def add(self, words: Counter) -> None:
        self.words.update(words)

    def model(self) -> tuple[ByOrder, ByOrder]:
        """By order and n-gram its discounted share, and by order and context what that leaves to the lower order.

        Below the highest order an n-gram counts once for each character seen before it, as
        Kneser-Ney has it; where it begins a word nothing can stand before it, and its times count.
        ``context`` has the place of each n-gram's context among those of its order.
        """
        names = list(self.words)
        rows = list(_rows_of(names, np.array([self.words[w] for w in names], dtype=np.float64)))
        shares, rests = [()] * (ORDER + 1), [()] * (ORDER + 1)
        followed = None
        for n, keys, contexts, suffixes, begins, times in reversed(rows):
            counts = times.astype(np.float64)
            if followed is not None:
                seen = dict(zip(followed[0].tolist(), followed[1].tolist(), strict=True))
                counts = np.where(begins, counts, [max(seen.get(k, 0), 1) for k in keys.tolist()])
            over, context = np.unique(contexts, return_inverse=True)
            total, kinds = np.bincount(context, weights=counts), np.bincount(context)
            shares[n] = keys, (np.maximum(counts - DISCOUNT, 0) / total[context]).astype(np.float32)
            rests[n] = over, (DISCOUNT * kinds / total).astype(np.float32)
            self.times[n], self.context[n] = times, context
            followed = np.unique(suffixes, return_counts=True)
        return _by_order(shares, rests, followed)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("toxicity")  # lets go of what other operators keep
    words = Counter()

    def rows() -> pa.RecordBatch:
        columns = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
        words.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "times"])

    for batch in batches:
        for text in batch.column(0):
            words.update(words_of(text.as_py()))
            if len(words) > KEPT_WORDS:
                yield rows()
    if words:
        yield rows()


GRAM_COLUMNS = "n int, key long, context long, suffix long, begins boolean, times long"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        times = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        for n, keys, contexts, suffixes, begins, summed in _rows_of(batch.column(0).to_pylist(), times):
            columns = [np.full(len(keys), n, np.int32), *(x.view(np.int64) for x in (keys, contexts, suffixes)), begins, summed]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "key", "context", "suffix", "begins", "times"])


def _judged_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = sorted({w for text in batch.column(0) for w in words_of(text.as_py())})
        for at in range(0, len(words), WORDS):
            contexts = np.unique(Model._highest(_Grams(words[at : at + WORDS]))[1])
            yield pa.RecordBatch.from_arrays([pa.array(contexts.view(np.int64))], ["context"])


def gram_table(docs: DataFrame) -> DataFrame:
    """(n, key, context, suffix, begins, share, rest) of each different n-gram of all ``docs``: the Kneser-Ney model as a
    table, keyed by whole hashes, which grows with the corpus. ``rest`` is what the context leaves to the lower order."""
    words = docs.select("text").mapInArrow(_count_words, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    grams = words.mapInArrow(_count_grams, GRAM_COLUMNS).groupBy("n", "key")
    grams = cut(grams.agg(*(F.min(c).alias(c) for c in ("context", "suffix", "begins")), F.sum("times").alias("times")))
    followed = grams.groupBy((F.col("n") - 1).alias("n"), F.col("suffix").alias("key")).agg(F.count("*").alias("followed"))
    counts = F.when((F.col("n") == ORDER) | F.col("begins"), F.col("times")).otherwise(F.greatest(F.coalesce("followed", F.lit(0)), F.lit(1)))
    counted = grams.join(followed, ["n", "key"], "left").withColumn("counts", counts)
    totals = counted.groupBy("n", "context").agg(F.sum("counts").alias("total"), F.count("*").alias("kinds"))
    return counted.join(totals, ["n", "context"]).select(
        "n", "key", "context", "suffix", "begins", (F.greatest(F.col("counts") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("share"),
        (DISCOUNT * F.col("kinds") / F.col("total")).alias("rest"),
    )


def shared_model(docs: DataFrame, rows: DataFrame) -> tuple[ByOrder, ByOrder]:
    """Of the model of all ``docs`` what class models learned from ``rows`` can ask for.

    After a context that stands in none of ``rows`` both classes give what the shared model gives, so
    the ratio is 0 whatever that is. Only n-grams after the other contexts, and what those back off
    to, are collected: their number is bounded by the contexts of the sample and the characters that
    follow them.
    """
    table = cut(gram_table(docs))
    judged = rows.select("text").mapInArrow(_judged_contexts, "context long").distinct()
    asked = cut(table.where((F.col("n") == ORDER) | F.col("begins")).join(judged, "context", "left_semi"))
    shares, rests, lower = [()] * (ORDER + 1), [()] * (ORDER + 1), None
    for n in range(ORDER, 1, -1):
        keys = asked.where(F.col("n") == n).select("key")
        if lower is not None:
            keys = keys.union(lower.select(F.col("suffix").alias("key")))
        lower = table.where(F.col("n") == n).join(keys.distinct(), "key", "left_semi")
        lower = cut(lower.select("key", "context", "suffix", "share", "rest"))
        got = lower.select("key", "context", "share", "rest").toPandas()
        keys, contexts = (got[c].to_numpy(np.int64).view(np.uint64) for c in ("key", "context"))
        order = np.argsort(keys)
        shares[n] = keys[order], got["share"].to_numpy(np.float32)[order]
        over, where = np.unique(contexts, return_index=True)
        rests[n] = over, got["rest"].to_numpy(np.float32)[where]
    single = table.where("n = 2").groupBy("suffix").agg(F.count("*").alias("followed")).orderBy("suffix").toPandas()
    keys, followed = single["suffix"].to_numpy(np.int64).view(np.uint64), single["followed"].to_numpy(np.float64)
    order = np.argsort(keys)
    return _by_order(shares, rests, (keys[order], followed[order]))


class ClassCounts:
    """In how many texts of each class the longest n-grams stand: sorted keys, their contexts and two columns of counts.

    A text counts an n-gram once for each different word that has it. Words are let go once they are
    counted, so memory follows the different n-grams.
    """

    def __init__(self):
        self.keys, self.contexts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2))

    def add(self, texts: list[tuple[list[str], int]]) -> None:
        """Words and classes (0 ordinary, 1 toxic) of some texts."""
        number: dict[str, int] = {}
        pairs = [(number.setdefault(w, len(number)), label) for words, label in texts for w in set(words)]
        times = np.zeros((len(number), 2))
        np.add.at(times, tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T), 1)
        names = list(number)
        for at in range(0, len(names), WORDS):
            grams = _Grams(names[at : at + WORDS])
            keys, contexts, places = Model._highest(grams)
            self._merge(keys, contexts, times[at + grams.word[places]])

    def add_counts(self, other: ClassCounts) -> None:
        self._merge(other.keys, other.contexts, other.counts)

    def _merge(self, keys: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> None:
        keys, contexts, counts = (np.concatenate(x) for x in zip((self.keys, self.contexts, self.counts), (keys, contexts, counts), strict=True))
        self.keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        self.contexts = contexts[first]
        self.counts = np.stack([np.bincount(back, weights=counts[:, c], minlength=len(first)) for c in (0, 1)], axis=1)


class Model:
    """Kneser-Ney models of two classes over a shared one."""

    def __init__(self, shared: tuple[ByOrder, ByOrder], classes: ClassCounts):
        self.share, self.rest = shared
        self.known = _Ratios(self)
        kinds, counts = classes.keys, classes.counts.T
        over, which = np.unique(classes.contexts, return_inverse=True)
        share, rest = np.zeros((len(kinds), 2)), np.ones((len(over), 2))
        for c in (0, 1):
            once, twice = (counts[c] == 1).sum(), (counts[c] == 2).sum()
            d = max(0.5, once / (once + 2 * twice)) if once else 0.75
            taken = np.where(counts[c] > 1, d, counts[c])  # what stands in one text only says nothing of the class
            total = np.bincount(which, weights=counts[c], minlength=len(over))
            share[:, c] = (counts[c] - taken) / np.maximum(total[which], 1)
            rest[:, c] = np.where(total > 0, np.bincount(which, weights=taken, minlength=len(over)) / np.maximum(total, 1), 1.0)
        often = share.any(axis=1)
        self.kinds, self.shares = kinds[often], share[often].astype(np.float32)
        self.over, self.rests = over, rest.astype(np.float32)

    @staticmethod
    def _highest(grams: _Grams) -> tuple[np.ndarray, ...]:
        """(key, context, place) of the longest n-gram inside the word that ends at each character, ORDER long at most."""
        at = np.flatnonzero(grams.known(2))
        keys, contexts = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for n in range(2, ORDER + 1):
            longest = grams.place[at] == n - 1 if n < ORDER else grams.place[at] >= n - 1
            keys[longest], contexts[longest] = grams.key(n)[at[longest]], grams.context(n)[at[longest]]
        return keys, contexts, at

    def ratios(self, words: list[str]) -> np.ndarray:
        """Logarithm of the toxic over the ordinary likelihood of each word."""
        grams = _Grams(words)
        keys, contexts, at = self._highest(grams)
        if not len(at):
            return np.zeros(len(words))
        words_at = grams.word[at]
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)  # each n-gram is looked up once
        # after any other context both classes give what the shared model gives
        over = _find(self.over, contexts[first])
        judged = np.flatnonzero(over >= 0)
        keys, over, at = keys[judged], over[judged], at[first[judged]]
        lower = self.share.of(1, grams.key(1)[at])
        for n in range(2, ORDER + 1):
            inside = grams.known(n)[at]
            to = at[inside]
            lower[inside] = self.share.of(n, grams.key(n)[to]) + self.rest.of(n, grams.context(n)[to]) * lower[inside]
        p = lower[:, None] * self.rests[over]
        kind = _find(self.kinds, keys)
        p[kind >= 0] += self.shares[kind[kind >= 0]]
        ratio = np.zeros(len(first))
        ratio[judged] = np.log(np.maximum(p[:, 1], 1e-12)) - np.log(np.maximum(p[:, 0], 1e-12))
        return np.bincount(words_at, weights=ratio[back], minlength=len(words))

    def judged(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, the mean ratio of the SHARE-th of its words that has the highest ones; 0 without words."""
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        split = [words_of(t) for t in texts]
        at = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))
        ratios = known.all()[at]
        out, done = np.zeros(len(texts)), 0
        for i, words in enumerate(split):
            if n := len(words):
                r, top = ratios[done : done + n], 1 + n // SHARE
                out[i] = np.partition(r, n - top)[n - top :].mean()
                done += n
        return out


class _Ratios(dict):
    """Numbers of words, and their ratios, which are worked out together for all new ones."""

    def __init__(self, model: Model):
        self.model, self.ratios = model, np.zeros(0)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number

    def clear(self) -> None:
        super().clear()
        self.ratios = np.zeros(0)

    def all(self) -> np.ndarray:
        new = list(itertools.islice(self, len(self.ratios), None))
        more = [np.clip(self.model.ratios(new[at : at + WORDS]), -MOST, MOST) for at in range(0, len(new), WORDS)]
        self.ratios = np.concatenate([self.ratios, *more])
        return self.ratios


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on standardised features with a small ridge.

    Newton steps, halved until they lower the loss: it is convex, so they end at its least value, on
    classes that can be told apart completely as well.
    """
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(np.logaddexp(0, np.where(y > 0, -t, t)).sum() + (keep * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        after = loss(w + size * step)
        if now - after < 1e-9 * max(1.0, abs(now)):
            break
        w, now = w + size * step, after
    weights = w[:-1] / scale
    return np.r_[weights, w[-1] - weights @ mean]


def train(lower: tuple[ByOrder, ByOrder], rows: Iterable[tuple[str, int]]) -> tuple[Model, np.ndarray]:
    """The models, and the two weights of the calibration, which is fitted on texts that their models have not seen."""
    rows = list(rows)
    halves, counts = (rows[::2], rows[1::2]), (ClassCounts(), ClassCounts())
    for half, classes in zip(halves, counts, strict=True):
        for some in _by_size(half):
            classes.add([(words_of(t), label) for t, label in some])
    x, y = [], []
    for i in (0, 1):
        model = Model(lower, counts[1 - i])
        for some in _by_size(halves[i]):
            x.append(model.judged([t for t, _ in some]))
            y += [label for _, label in some]
    model = None
    counts[0].add_counts(counts[1])
    return Model(lower, counts[0]), _logistic(np.concatenate(x)[:, None], np.array(y, dtype=float))


def _by_size(rows: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    """The rows in runs of CHUNK characters about."""
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += len(row[0] or "")
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


PARTS = ("kinds", "shares", "over", "rests")


def _packed(model: Model, weights: np.ndarray) -> bytes:
    orders = {
        f"{name}_{part}_{n}": x
        for name in ("share", "rest") for part, xs in (("keys", getattr(model, name).keys), ("values", getattr(model, name)))
        for n, x in enumerate(xs)
    }
    missing = {f"{name}_missing": np.array(getattr(model, name).missing) for name in ("share", "rest")}
    np.savez_compressed(out := io.BytesIO(), weights=weights, **orders, **missing, **{k: getattr(model, k) for k in PARTS})
    return out.getvalue()


def _unpacked(data: bytes) -> tuple[Model, np.ndarray]:
    stored = np.load(io.BytesIO(data))
    model = Model.__new__(Model)
    model.known = _Ratios(model)
    for k in PARTS:
        setattr(model, k, stored[k])
    for name in ("share", "rest"):
        keys, values = ([stored[f"{name}_{part}_{n}"] for n in range(ORDER + 1)] for part in ("keys", "values"))
        setattr(model, name, ByOrder(keys, values, stored[f"{name}_missing"].tolist()))
    return model, stored["weights"]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | float:
    """The models as bytes; where labels of one kind are missing, the share of toxic ones instead.

    The class models come from at most ``sample`` labelled rows outside the held-out fold, read by one
    task; the shared counts from every row.
    """
    rows = cut(training_rows(docs, labels, "toxic", FOLDS, HELD, sample))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return (toxic + 0.1) / (n + 1)
    shared = docs.sparkSession.sparkContext.broadcast(shared_model(docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        got = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        got.sort(key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([_packed(*train(shared.value, [r[1:] for r in got]))], pa.binary())], ["model"])

    keyed = rows.select(F.xxhash64("doc_id", "text").alias("k"), "text", "label")
    return keyed.coalesce(1).mapInArrow(run, "model binary").first().model


def _scored(docs: DataFrame, model: bytes | float) -> DataFrame:
    """``docs`` and a column ``score``; ``docs`` has a column ``text`` and none of that name."""
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, key = worker_cache("toxicity"), zlib.crc32(shared.value)
        if key not in cache:  # one model at a time
            cache.clear()
            cache[key] = _unpacked(shared.value)
        models, weights = cache[key]
        for batch in batches:
            for part, texts in parts(batch, names.index("text"), CHUNK):
                values = 1 / (1 + np.exp(-np.clip(weights[0] * models.judged(texts) + weights[1], -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", score double")


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, any others).

    A null text scores as an empty one, which has no word and is judged by the bias alone. Repeated
    rows and equal texts get equal scores. Without labels of both kinds every text scores the share
    of toxic labels. No rows give no rows.
    """
    return _scored(docs.select("doc_id", "text"), fit(docs, labels, sample)).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with their columns; order, ties and copies as they are."""
    names = docs.columns
    numbered = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(names)])
    return _scored(numbered, fit(docs, labels, sample)).where(F.col("score") < THRESHOLD).drop("score").toDF(*names)
