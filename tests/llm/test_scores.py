"""Quality and toxicity on small corpora with held-out rows, and on edge cases."""

import collections
import random
import zlib

import numpy as np
import pytest

from rangeparts.llm import quality, toxicity

WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "se", "ti", "vo") for c in ("n", "r", "s", "")]
RUDE = ["grubnak", "grubvol", "grubtis", "zolfrag", "zolfin"]


def corpus(seed, n=700):
    """(doc_id, text, quality, toxic)"""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.8)
        if toxic:
            for _ in range(2 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        if not good:
            words = rng.choice([[w + rng.choice(("%%%", "&&&", "###")) for w in words], [w for w in words for _ in range(5)], [x for w in words for x in (w, "|")]])
        rows.append((i, " ".join(words), good, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality_on_held_out_rows(tables):
    rows, docs, labels = tables
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i].predicted, q) for i, _, q, _ in rows if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_toxicity_on_held_out_rows(tables):
    rows, docs, labels = tables
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [(got[i].predicted, x) for i, _, _, x in rows if got[i].held_out]
    assert np.mean([p == x for p, x in held]) > 0.95


def test_held_out_labels_are_not_used(tables, spark):
    rows, docs, labels = tables
    turned = spark.createDataFrame(
        [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, _, q, x in rows],
        "doc_id long, quality int, toxic int",
    )
    for m in (quality, toxicity):
        a, b = ({r.doc_id: r.score for r in m.scores(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_filters_keep_what_they_should(tables):
    rows, docs, labels = tables
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == bool(q) for i, _, q, _ in rows]) > 0.95
    ids = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert np.mean([(i in ids) != bool(x) for i, _, _, x in rows]) > 0.95


def test_edges(edge_documents, documents, tables, spark):
    _, _, labels = tables
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for given in (labels, none, nulls):
        for m in (quality, toxicity):
            rows = m.scores(edge_documents, given).collect()
            assert len(rows) == edge_documents.count() and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1  # null, empty, blank
            assert m.scores(documents(), given).count() == 0
    assert quality.keep_good(edge_documents, none).count() == edge_documents.count()
    assert toxicity.drop_toxic(edge_documents, none).count() == edge_documents.count()
    assert quality.keep_good(edge_documents, none).columns == edge_documents.columns
    assert toxicity.drop_toxic(edge_documents, labels).columns == edge_documents.columns


def test_leader_updates_match_one_by_one():
    """FTRL-proximal over dictionaries, as it is written down, gives the same weights."""
    rng = random.Random(4)
    rows = [(np.array([rng.randrange(16) for _ in range(rng.randrange(1, 9))]), rng.randrange(2)) for _ in range(40)]
    got, bias = quality.train(rows, bits=4)
    z, n, bz, bn = [0.0] * 16, [0.0] * 16, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    def offset():
        return -bz / ((quality.BETA + bn**0.5) / quality.ALPHA)

    for _ in range(quality.EPOCHS):
        for slots, y in rows:
            x = {i: slots.tolist().count(i) / len(slots) ** 0.5 for i in set(slots.tolist())}
            w = {i: weight(i) for i in x}
            bias_now = offset()
            error = 1 / (1 + np.exp(-(sum(w[i] * x[i] for i in x) + bias_now))) - y
            for i in x:
                g = error * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
                n[i] += g * g
            bz += error - ((bn + error**2) ** 0.5 - bn**0.5) / quality.ALPHA * bias_now
            bn += error**2
    assert np.allclose(got, [weight(i) for i in range(16)], atol=1e-6)


def test_shared_model_is_a_distribution():
    """Over the characters that can follow, shares and what is left for the lower order sum up to one."""
    from collections import Counter

    shared = toxicity.Shared()
    shared.add(Counter({w: 3 for w in WORDS}))
    share, rest = shared.model()
    for n in range(2, toxicity.ORDER + 1):
        contexts = shared.context[n][shared.times[n] > 0]
        total = np.bincount(contexts, weights=share[n][shared.times[n] > 0], minlength=1 << toxicity.SHARED_SLOTS)
        used = np.unique(contexts)
        assert np.allclose(total[used] + rest[n][used], 1, atol=1e-5)


def class_counts(ordinary, toxic):
    """Counts of words by the number of texts that have them."""
    classes = toxicity.ClassCounts()
    for label, counts in enumerate((ordinary, toxic)):
        for n in range(max(counts.values(), default=0)):
            classes.add([([w for w, c in counts.items() if c > n], label)])
    return classes


def slow_ratio(word, corpus_words, classes):
    """Logarithm of the ratio of two Kneser-Ney models, counted over strings as it is written down."""
    top = toxicity.ORDER
    marked = lambda w: f"\x02{w}\x03"
    times = {n: collections.Counter() for n in range(2, top + 1)}
    for w, c in corpus_words.items():
        for n in times:
            for i in range(len(marked(w)) - n + 1):
                times[n][marked(w)[i : i + n]] += c
    before = {g: {h[0] for h in times[n + 1] if h[1:] == g} for n in range(2, top) for g in times[n]}
    value = {g: c if n == top or g[0] == "\x02" else max(len(before[g]), 1) for n in times for g, c in times[n].items()}
    ends = collections.Counter(g[1] for g in times[2])
    whole = sum(ends.values()) + 0.5 * 2**toxicity.SHARED_SLOTS

    def shared(gram):
        if len(gram) == 1:
            return (ends[gram] + 0.5) / whole
        same = {g: v for g, v in value.items() if len(g) == len(gram) and g[:-1] == gram[:-1]}
        if not same:
            return shared(gram[1:])
        share = max(same[gram] - 0.75, 0) / sum(same.values()) if gram in same else 0
        return share + 0.75 * len(same) / sum(same.values()) * shared(gram[1:])

    longest = lambda w: [marked(w)[max(0, i - top + 1) : i + 1] for i in range(1, len(w) + 2)]
    tables = []
    for texts in classes:
        counts = collections.Counter(g for t in texts for w in set(t) for g in longest(w))
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        tables.append((counts, max(0.5, once / (once + 2 * twice)) if once else 0.75))
    total = 0.0
    for gram in longest(word):
        if not any(g[:-1] == gram[:-1] for counts, _ in tables for g in counts):
            continue  # neither class has the context: both are the shared model
        p = []
        for counts, d in tables:
            same = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
            taken = {g: d if c > 1 else c for g, c in same.items()}
            n = sum(same.values())
            own = (same.get(gram, 0) - taken.get(gram, 0)) / n if n else 0
            p.append(own + (sum(taken.values()) / n if n else 1) * shared(gram))
        total += np.log(p[1]) - np.log(p[0])
    return total


def test_ratios_match_brute_force():
    rng = random.Random(3)
    small = ["ba", "bara", "kes", "kera", "liro", "abara", "ak"]
    texts = [([rng.choice(small) for _ in range(6)] + ["zolf"] * (i % 3 == 0), int(i % 3 == 0)) for i in range(24)]
    words = collections.Counter(w for t, _ in texts for w in t) + collections.Counter({"ralik": 2, "o": 1})
    shared = toxicity.Shared()
    shared.add(words)
    classes = toxicity.ClassCounts()
    classes.add(texts[:9])
    classes.add(texts[9:])
    model = toxicity.Model(shared.model(), classes)
    names = [*words, "zzz", "zol", "barak"]
    want = [slow_ratio(w, words, [[t for t, y in texts if y == c] for c in (0, 1)]) for w in names]
    assert np.allclose(model.ratios(names), want, atol=1e-4) and model.ratios(["zolf"])[0] > 1
    text = ["ba"] * 120 + ["zolf"]
    r = sorted(np.clip(model.ratios(text), -toxicity.MOST, toxicity.MOST))
    assert np.isclose(model.judged([" ".join(text), "", None])[0], np.mean(r[-3:])) and model.judged(["", None]).tolist() == [0, 0]


def test_unknown_words_say_nothing():
    from collections import Counter

    shared = toxicity.Shared()
    shared.add(Counter(WORDS))
    model = toxicity.Model(shared.model(), class_counts(Counter({w: 5 for w in WORDS}), Counter({w: 1 for w in WORDS} | {w: 5 for w in RUDE})))
    ratios = dict(zip(["qqq", *WORDS, *RUDE], model.ratios(["qqq", *WORDS, *RUDE]), strict=True))
    assert min(ratios[w] for w in RUDE) > 2 > abs(ratios["qqq"])
    assert max(ratios[w] for w in WORDS) < 1


def test_shared_counts_tell_all_ngrams_apart(documents):
    """More n-grams than 2 ** SHARED_SLOTS: each has the share that counting without hashes gives it."""
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(70_000)]
    counts = collections.Counter(names)
    marked = {f"\x02{w}\x03": c for w, c in counts.items()}
    times = {n: collections.Counter() for n in range(2, toxicity.ORDER + 1)}
    for w, c in marked.items():
        for n in times:
            for i in range(len(w) - n + 1):
                times[n][w[i : i + n]] += c
    assert len(times[toxicity.ORDER]) > 1 << (toxicity.SHARED_SLOTS - 1)
    followed = collections.Counter(g[1:] for n in times for g in times[n])
    table = toxicity.gram_table(documents(*(" ".join(names[i::50]) for i in range(50)))).toPandas()
    assert len(table) == sum(len(t) for t in times.values())
    got = dict(zip(zip(table["n"], table["key"], strict=True), zip(table["share"], table["rest"], strict=True), strict=True))
    model = toxicity.Shared()
    model.add(counts)
    share, rest = model.model()
    for n in times:
        value = {g: c if n == toxicity.ORDER or g[0] == "\x02" else followed[g] for g, c in times[n].items()}
        total, kinds = collections.Counter(), collections.Counter()
        for g, c in value.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        some = rng.sample(sorted(w for w in counts if len(w) >= n), 300)
        for w in some:
            grams, end = toxicity._Grams([w]), len(w) + 1
            g = f"\x02{w}\x03"[end - n + 1 : end + 1]
            want = max(value[g] - 0.75, 0) / total[g[:-1]], 0.75 * kinds[g[:-1]] / total[g[:-1]]
            key, context = grams.key(n)[end:], grams.context(n)[end:]
            assert np.allclose(got[n, key.view(np.int64)[0]], want)
            assert np.allclose((share.of(n, key)[0], rest.of(n, context)[0]), want)


def test_what_is_collected_gives_the_same_ratios(documents, spark):
    """Class models over the collected part of the shared model judge as over all of it."""
    texts = [t for _, t, _, _ in corpus(9, 80)]
    some = documents(*texts[:20])
    counts = collections.Counter(w for t in texts for w in toxicity.words_of(t))
    shared = toxicity.Shared()
    shared.add(counts)
    classes = toxicity.ClassCounts()
    classes.add([(toxicity.words_of(t), i % 2) for i, t in enumerate(texts[:20])])
    names = sorted(counts)
    whole = toxicity.Model(shared.model(), classes).ratios(names)
    part = toxicity.Model(toxicity.shared_model(documents(*texts), some), classes)
    assert np.any(whole) and np.allclose(part.ratios(names), whole, atol=1e-5)
    again, _ = toxicity._unpacked(toxicity._packed(part, np.zeros(2)))
    assert np.array_equal(again.ratios(names), part.ratios(names))


def test_class_models_lose_no_ngram():
    """However many there are, and whatever places their hashes ask for."""
    rng = random.Random(11)
    names = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(150_000)})
    shared = toxicity.Shared()
    shared.add(collections.Counter(names[:1000]))
    model = toxicity.Model(shared.model(), class_counts(dict.fromkeys(names, 2), {"zz": 2}))
    some = toxicity._Grams(names[::50])
    keys, contexts, _ = model._highest(some)
    assert (toxicity._find(model.kinds, keys) >= 0).all() and (toxicity._find(model.over, contexts) >= 0).all()
