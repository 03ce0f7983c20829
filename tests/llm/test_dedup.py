"""SimHash groups, line dedup and winnowing against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rangeparts.llm import common, linededup, simhash, winnowing

WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "se", "ti", "vo") for c in ("n", "r", "s", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, times=1):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


# -- SimHash -----------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    for text in [None, "", " \t", "A", "a b c", "a b c d", "A\x0bB\x0cC\rD e", "a a a a a a", "É é Ü ß"] + [prose(rng, n) for n in range(1, 60)]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_hashes_alike(spark):
    """The seed and the variant are those of Spark's own function."""
    for text in ("", "a", "words that are longer than thirty-two bytes of text", "éü"):
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("n", [10, 1 << 24, 1 << 31, 1 << 40])
def test_masks_find_every_link(n):
    masks = simhash.plan_masks(n)
    rng = random.Random(n)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("block", [4096, 20])
def test_near_duplicates_match_brute_force(documents, block):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(3, 200)) for _ in range(60)]
    texts += [edited(rng, rng.choice(texts[:20]), rng.randrange(3)) for _ in range(150)]
    hub = prose(rng, 300)
    texts += [edited(rng, hub, 2) for _ in range(90)]  # more in one variant than a small block holds
    rng.shuffle(texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(*texts), block=block).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps, 4)


def test_chains_are_one_component(spark):
    rng = random.Random(3)
    chain = [0]
    for i in range(200):
        chain.append(chain[-1] ^ 1 << rng.randrange(63))
    edges = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)], "a long, b long")
    rows = simhash.components(edges).collect()
    assert {r.root for r in rows} == {min(chain)}
    assert {r.node for r in rows} == set(chain) - {min(chain)}


@pytest.mark.parametrize("copies", [None, 2])
def test_full_variants_are_linked_by_finer_masks(spark, copies):
    """One in three fingerprints is near one centre, in more blocks of a variant than it may be copied to."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(400)}
    while len(fps) < 600:
        x = centre
        for b in rng.sample(range(64), rng.randrange(8)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    prints = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(prints, block=16, copies=copies).collect()]
    assert all(a != b and (a ^ b).bit_count() <= 4 for a, b in pairs)
    place = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        i, j = find(place[a]), find(place[b])
        root[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fps))] == [place[fps[i]] for i in slow_components(fps, 4)]


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    """Hubs and large groups of copies get the same results without a shuffle."""
    rng = random.Random(6)
    edges = {(0, i) for i in range(1, 300)} | {(1000 - i, 1000) for i in range(1, 300)} | {(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)}
    edges = spark.createDataFrame(sorted(edges), "a long, b long")
    want = sorted(map(tuple, simhash.components(edges).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    assert sorted(map(tuple, simhash.components(edges).collect())) == want
    rows = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(200)], "k long, v long")
    values = rows.groupBy("k").agg(F.max("v").alias("most"), F.count("*").alias("times"))
    got = common.met(rows, values, "k", 200)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(values.drop("times"), "k").collect()))


def test_simhash_edges(spark, edge_documents, documents):
    rows = simhash.near_duplicates(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in empty} == {0} and len(empty) >= 4  # null, empty, blank, and the null without an id
    assert next(r for r in rows if r.doc_id is None and r.fingerprint != "0" * 16).component_id in (None, *range(9))
    assert simhash.near_duplicates(documents()).collect() == []
    kept = simhash.keep_first(edge_documents)
    assert kept.columns == edge_documents.columns and kept.count() < edge_documents.count()
    assert simhash.keep_first(documents()).count() == 0


# -- line dedup --------------------------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def units(line):
    words = line.split(" ")
    return (True, words) if len(words) >= linededup.WORDS else (False, list(line))


def near(a, b):
    (x, p), (y, q) = units(a), units(b)
    return x == y and (x or min(len(a), len(b)) >= linededup.NEAR_CHARS) and within_one(p, q)


def slow_lines(texts):
    seen, out = [], {}
    for d, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            if s := line.strip(" ").lower():
                if s in {x for x, *_ in seen}:
                    out[d, n] = False
                elif any(near(s, x) for x, *_ in seen):
                    out[d, n] = True
                seen.append((s, d, n))
    return out


def one_edit(rng, line):
    """A character or a word put in, left out or replaced."""
    x = line.split(" ") if rng.random() < 0.6 or not line else list(line)
    i, c = rng.randrange(len(x)), rng.choice(("xyz", "é", "", "kan") if len(x) < len(line) else "xyzé ")
    return (" " if len(x) < len(line) else "").join(rng.choice([x[:i] + x[i + 1 :], x[:i] + [c] + x[i:], x[:i] + [c] + x[i + 1 :]]))


def line_texts(seed):
    rng = random.Random(seed)
    lines = [prose(rng, rng.randrange(1, 30)) for _ in range(40)] + [prose(rng, rng.randrange(60, 400)) for _ in range(6)]
    lines += ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(10, 200))) for _ in range(8)] + ["x", "ab", "}"]
    pool = lines + [one_edit(rng, rng.choice(lines)) for _ in range(110)] + [one_edit(rng, one_edit(rng, rng.choice(lines))) for _ in range(30)]
    pool += ["page number %d of a long report about lines" % i for i in range(12)]
    return ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))) for _ in range(80)]


@pytest.mark.parametrize("seed", [1, 2])
def test_dropped_lines_match_brute_force(documents, seed):
    texts = line_texts(seed)
    want = slow_lines(texts)
    got = {(r.id, r.no): r.near for r in linededup.dropped_lines(documents(*texts)).collect()}
    # a line that equals a later copy of a near line is told as equal; both go
    assert set(got) == set(want)
    assert {k for k, near in got.items() if near} >= {k for k, near in want.items() if near} - {k for k, near in got.items() if not near}


def test_report_and_texts_agree(documents):
    texts = line_texts(3)
    gone = slow_lines(texts)
    docs = documents(*texts)
    report = {r.doc_id: r for r in linededup.report(docs).collect()}
    kept = {r.doc_id: r for r in linededup.dedup(docs).collect()}
    for d, text in enumerate(texts):
        lines = text.split("\n")
        left = [line for n, line in enumerate(lines) if (d, n) not in gone]
        r = report[d]
        assert r.n_lines == len(lines)
        assert sorted(int(x) for s in (r.exact_lines, r.near_lines) for x in s.split(",") if x) == sorted(n for e, n in gone if e == d)
        if any(x.strip() for x in left):
            assert kept[d].text == "\n".join(left) and kept[d].n_chars == len(kept[d].text)
        else:
            assert d not in kept


def test_line_edges(edge_documents, documents):
    rows = linededup.report(edge_documents).collect()
    assert len(rows) == edge_documents.distinct().count()
    long = next(r for r in rows if r.n_lines == 50)
    assert long.exact_lines == ",".join(map(str, range(1, 50)))
    kept = linededup.dedup(edge_documents)
    assert kept.columns == edge_documents.columns
    assert {r.text for r in kept.collect()} >= {None, "", "a", "no id", "same line of some length here"}
    assert linededup.report(documents()).count() == 0 and linededup.dedup(documents()).count() == 0


def test_rows_given_twice_keep_their_lines(documents):
    line = "a line that stands in a row given twice"
    assert [r.text for r in linededup.dedup(documents((1, line), (1, line))).collect()] == [line, line]
    assert [r.text for r in linededup.dedup(documents((2, line), (1, line))).collect()] == [line]


def test_long_lines_within_one_edit(documents):
    rng = random.Random(5)
    long = prose(rng, 3000)
    texts = [long, long[:9000] + "q" + long[9000:], long[:100] + long[101:], long.replace(" ", " again ", 1), edited(rng, edited(rng, long), 2)]
    assert {(r.id, r.near) for r in linededup.dropped_lines(documents(*texts)).collect()} == {(1, True), (2, True), (3, True)}


@pytest.mark.parametrize("gap", [6, 10**9])
def test_very_long_lines(documents, gap):
    """300,000 characters without a line end, as words and as one word, and each with one character changed."""
    import time

    rng = random.Random(6)
    long = "".join(" " if i % (gap + 1) == gap else rng.choice("abcdefgh") for i in range(300_000))
    texts = [long, long[:200_000] + "q" + long[200_001:], long + "x", long[:1001] + "q" + long[1002:200_000] + "q" + long[200_001:]]
    began = time.perf_counter()
    # the last has one edit from the second, if not from the first
    assert {(r.id, r.first_id, r.near) for r in linededup.dropped_lines(documents(*texts)).collect()} == {(1, 0, True), (2, 0, True), (3, 1, True)}
    assert time.perf_counter() - began < 90


def test_short_lines_go_for_equality_only(documents):
    got = {(r.id, r.near) for r in linededup.dropped_lines(documents("yes.", "yes.\nno.", "yes!", "", " ", "\n", "are, is anwh reenen.", "are is anwh reenen.")).collect()}
    assert got == {(1, False), (7, True)}


def test_any_changed_word_of_a_long_line(documents):
    """Whatever the word, the partner is found; a second one is beyond the bound."""
    words = [f"word{i}" for i in range(70)]
    changed = [" ".join([*words[:i], "something else".split()[i % 2], *words[i + 1 :]]) for i in range(70)]
    twice = " ".join(["x", *words[1:50], "y", *words[51:]])
    got = {r.id: r.near for r in linededup.dropped_lines(documents(" ".join(words), *changed, twice)).collect()}
    assert got == dict.fromkeys(range(1, 71), True)


@pytest.mark.parametrize("n", [8, 31, 64, 65, 128])
def test_a_word_put_in_anywhere(documents, n):
    """At every place of lines that are as long as some chunks, or a little longer; and the longer line may be the earlier one."""
    rng = random.Random(n)
    base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    longer = [" ".join([*base[:i], "new", *base[i:]]) for i in range(n + 1)]
    assert {r.id for r in linededup.dropped_lines(documents(" ".join(base), *longer)).collect()} == set(range(1, n + 2))
    others = [[f"w{rng.randrange(10**9)}" for _ in range(n + 1)] for _ in range(n + 1)]
    pairs = [x for i, w in enumerate(others) for x in (" ".join(w), " ".join(w[:i] + w[i + 1 :]))]
    assert {(r.id, r.first_id) for r in linededup.dropped_lines(documents(*pairs)).collect()} == {(2 * i + 1, 2 * i) for i in range(n + 1)}


def test_line_dedup_is_native(documents):
    plan = linededup.report(documents("a"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


# -- winnowing ---------------------------------------------------------------------------------------


def slow_winnowing(text, k, w):
    data = text.encode()
    if len(data) < k:
        return winnowing.fingerprint(text, k, w).tolist()
    hashes = []
    for i in range(len(data) - k + 1):
        h = 0
        for b in data[i : i + k]:
            h = (h * winnowing.MULTIPLIER + int(winnowing._BYTES[b])) % (1 << 64)
        hashes.append((((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) % (1 << 64)) >> 32)
    w, out = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == least)
        if not out or out[-1] != [least, at]:
            out.append([least, at])
    return out


@pytest.mark.parametrize(("k", "w"), [(4, 5), (8, 16), (32, 100), (2, 1)])
def test_winnowing_matches_brute_force(k, w, monkeypatch):
    monkeypatch.setattr(winnowing, "BLOCK", 50)  # many blocks
    rng = random.Random(k)
    for text in ["", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 8, "éèü" * 40] + [prose(rng, n) for n in (1, 5, 40, 90)]:
        assert winnowing.fingerprint(text, k, w).tolist() == slow_winnowing(text, k, w)


def test_shared_passages_share_a_fingerprint():
    rng = random.Random(8)
    for _ in range(50):
        passage = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
        a, b = (winnowing.fingerprint(prose(rng, 50) + passage + prose(rng, 50)) for _ in range(2))
        assert set(a[:, 0].tolist()) & set(b[:, 0].tolist())


def test_compared(spark, documents):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(80)] + [""]
    ids = rng.sample(range(10**9), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    got = sorted(winnowing.compared(documents(*rng.sample(rows, len(rows)))).collect())
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for n, r in enumerate(got):
        text, following = rows[n][1], rows[(n + 1) % len(rows)][1]
        m = len(text) // 4
        edited_text = text[: len(text) - m] + following[:m]
        a, b, c = (winnowing.fingerprint(t) for t in (text, edited_text, following))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited_text.encode()).hexdigest()
        assert winnowing.read(r.fingerprint).tolist() == a.tolist() and r.edited_fingerprint == winnowing.written(b)
        x, y, z = ({*p[:, 0].tolist()} for p in (a, b, c))
        assert r.near_edited == pytest.approx(len(x & y) / len(x | y) if x | y else 1)
        assert r.near_next == pytest.approx(len(x & z) / len(x | z) if x | z else 1)


def test_winnowing_edges(edge_documents, documents):
    rows = winnowing.compared(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    assert winnowing.compared(documents()).collect() == []
    one = winnowing.compared(documents((5, "only text of all"))).first()
    assert one.near_next == 1.0
    assert {r.fingerprint for r in winnowing.fingerprints(documents(None, "")).collect()} == {""}
    assert np.isfinite([r.near_edited for r in rows]).all()


def test_near_copies_of_short_texts_are_alike():
    """With a quarter replaced, three quarters are the same bytes, and some of their hashes are."""
    rng = random.Random(10)
    for n in (6, 8, 12, 25, 60):
        for _ in range(40):
            text, following = prose(rng, n), prose(rng, n)
            a, b = winnowing.fingerprint(text), winnowing.fingerprint(winnowing.edited_text(text, following))
            assert len(a) > 1 and 0 < winnowing.likeness(a, b)
