"""Extraction, packing, sound files, sampled pieces and license scans."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rangeparts.llm import audio, licenses, packing, pieces, sitestyle

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# -- extraction --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a></ul></nav><div class="ad">Buy!</div><div id="cookie-notice">Cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One  <b>bold</b>
 &#233;nd<p>Two<br>lines<!-- no --><ul><li>a<li>b</ul><div class="share-buttons">Share</div><form><label>Mail</label><input></form>
<table><tr><td>c<td>d</table><section class="comments"><p>Nice!</p></section></article></main><aside>Side</aside><p>out</p><footer>&copy; x</footer>"""


def test_blocks():
    assert sitestyle.blocks(sitestyle.parse(PAGE)) == ["Title & more", "One bold énd", "Two lines", "a", "b", "c", "d"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("plain  text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<div>a<span>b</span>c</div>d", ["abc", "d"]), ("a < b & c", ["a < b & c"]),
        ("<p>&lt;b&gt;&nbsp;x</p>", ["<b> x"]), ("<p><b>a</p><p>b</b></p>", ["a", "b"]), ("<p title='>'>a</p>", ["a"]), ("<p title='>a</p>", ["a"]), ("</p></div>a", ["a"]),
        ("<script>if (a</b) '<p>'</script>x<style>", ["x"]), ("<textarea><p>a</textarea>b", ["b"]), ("<!-- a -- b", []), ("<article class='comment'>c</article><article>a</article>", ["a"]),
        ("<article>a</article><article>b</article>", ["a", "b"]), ("<article>a<article>b</article>c</article>d", ["a", "b", "c"]), ("<div role=main>m</div>x", ["m"]),
        ("<p>a<p hidden>b<p style='display:none'>c", ["a"]), ("<p>a<![CDATA[b]]></p>", ["ab"]), ("<div>" * 3000 + "deep", ["deep"]),
    ],
)
def test_odd_pages(page, want):
    assert sitestyle.blocks(sitestyle.parse(page)) == want


def test_site_furniture_is_found_by_its_sameness(spark):
    """Without tags or names to tell it by: what all pages of a host have goes, what differs stays."""
    rng = random.Random(1)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(12))
    rows, want = [], {}
    for i in range(30):
        a, b = text(), text()
        rows.append((i, f"https://one.example/{i}", f"<div class=x1><span>Welcome to us</span></div><div class=x2><p>{a}</p><p>{b}</p></div><div class=x3>All rights kept</div>", 1))
        want[i] = f"{a}\n{b}"
    rows.append((99, "https://two.example/", "<div class=x1><span>Welcome to us</span></div>", 1))  # a host with one page
    want[99] = "Welcome to us"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    got = {r.page_id: r.text for r in sitestyle.main_texts(pages).collect()}
    assert got == want
    scores = {(r.host, r.pages): r.importance for r in sitestyle.importances(sitestyle.style_nodes(pages)).collect()}
    assert {h for h, _ in scores} == {"one.example"}  # the other host has too few pages to say


def slow_low_nodes(pages, low, min_pages):
    """Hosts' style nodes of low importance, by the definitions, one node at a time."""
    seen = {}  # host -> node -> (parent, pages, looks, contents), of pages that differ
    for host, text in {(sitestyle.host_of(u), t) for u, t in pages}:
        for node in sitestyle.nodes(sitestyle.parse(text)):
            if node.parent is None or node.tag in sitestyle.NO_TEXT:
                continue
            entry = seen.setdefault(host, {}).setdefault(node.key, (node.parent.key if node.parent.parent else -1, set(), {}, {}))
            entry[1].add(text)
            look = []
            for c in node.children:
                kind = c.key if isinstance(c, sitestyle.Node) else 0 if c.strip() else None
                if kind is not None and look[-1:] != [kind]:
                    look.append(kind)
            entry[2].setdefault(tuple(look), set()).add(text)
            own = [" ".join(c.split()) for c in node.children if isinstance(c, str)] + [node.attributes[k] for k in ("href", "src") if k in node.attributes]
            for c in own:
                if c:
                    entry[3].setdefault(c, set()).add(text)
    out = {}
    for host, tree in seen.items():

        def importance(key, tree=tree):
            _, on, looks, contents = tree[key]
            m = len(on)
            # each page counts once for each look that the node has on it
            total = sum(len(p) for p in looks.values())
            presentation = -sum(len(p) / total * np.log(len(p) / total) for p in looks.values()) / np.log(total) if total > 1 else 1.0
            children = [k for k, e in tree.items() if e[0] == key]
            values = [importance(k) if len(tree[k][1]) >= min_pages and rows(k) >= min_pages else 1.0 for k in children]
            if contents:
                values.append(max(0, 1 - np.mean([np.log(len(p)) for p in contents.values()]) / np.log(total)) if total > 1 else 1.0)
            inner, keep = (np.mean(values) if values else presentation), sitestyle.DECAY ** len(children)
            return (1 - keep) * presentation + keep * inner

        def rows(key, tree=tree):
            return sum(len(p) for p in tree[key][2].values())

        out[host] = frozenset(k for k in tree if rows(k) >= min_pages and importance(k) < low)
    return out


@pytest.mark.parametrize("small", [200_000, 0])
def test_trees_and_cuts_match_brute_force(spark, small, monkeypatch):
    """Random sites without tags or names that tell furniture; the tree changes their texts, in and outside of articles."""
    monkeypatch.setattr(sitestyle, "SMALL", small)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(("ba", "ke", "li", "mo", "nu", "ra")) + str(rng.randrange(50)) for _ in range(n))
    rows = []
    for site in range(3):
        top, under, box = text(4), text(5), text(6)
        for i in range(12 + 4 * site):
            body = "".join(f"<p>{text(8)}{'<i>x</i>' * rng.randrange(2)}</p>" for _ in range(rng.randrange(1, 4)))
            inside = f"<div class=q{site}><span>{box}</span></div>" if rng.random() < 0.9 else ""
            odd = f"<div class=odd{i}>{text(2)}</div>"
            core = f"<article>{body}{inside}{odd}</article>" if site else f"<div class=body>{body}{inside}{odd}</div>"
            rows.append((len(rows), f"https://s{site}.example/{i}", f"<div class=a><a href=/>{top}</a></div>{core}<div class=z>{under if rng.random() < 0.8 else text(3)}</div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    low = slow_low_nodes([r[1:] for r in rows], sitestyle.LOW, sitestyle.MIN_PAGES)
    want = {i: "\n".join(sitestyle.blocks(sitestyle.parse(t), low[sitestyle.host_of(u)])) for i, u, t in rows}
    got, uncut = ({r.page_id: r.text for r in sitestyle.main_texts(pages, low=x).collect()} for x in (sitestyle.LOW, -1.0))
    assert got == want
    assert sum(got[i] != uncut[i] for i in got) > 0.8 * len(got)


def test_lines_that_articles_share_stay(spark):
    rows = [(i, f"https://h.example/{i}", f"<nav>n</nav><article><h1>Title</h1><p>own {i}</p><p>The same words on every page.</p></article>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in sitestyle.main_texts(pages).collect()} == {f"Title\nown {i}\nThe same words on every page." for i in range(20)}


def test_importance_matches_the_formula(spark):
    """One element over four pages: contents x x y z, and two looks."""
    bodies = ["x", "x<i>p</i>", "y", "z"]
    pages = spark.createDataFrame([(k, "h", f"<p>{b}</p>{'<u></u>' * k}") for k, b in enumerate(bodies)], "page_id long, url string, html string")
    nodes = {(r.pages, r.texts): r for r in sitestyle.style_nodes(pages).collect()}
    p = nodes[4, 3]
    assert p.contents == pytest.approx(1 - np.mean([np.log(2), 0, 0]) / np.log(4))
    assert p.presentation == pytest.approx(-(0.75 * np.log(0.75) + 0.25 * np.log(0.25)) / np.log(4))


def test_page_edges(spark):
    schema = "page_id long, url string, html string, text string, low long"
    rows = [(1, None, None, "x", 1), (None, "https://a/", "", None, None), (2, "https://a/", "<p>a</p>", "", 1), (2, "https://a/", "<p>a</p>", "", 1), (3, "x", "<p>" + "w " * 50_000, "", 0)]
    got = sitestyle.main_texts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 99_999)]
    assert sitestyle.main_texts(spark.createDataFrame([], schema)).count() == 0
    assert [sitestyle.host_of(u) for u in ("https://u@A.b:80/x", None, "a.b/c?d", "HTTP://x")] == ["a.b", "", "a.b", "x"]


# -- packing -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(BPE)


@pytest.fixture(scope="module")
def fresh():
    return Tokenizer.from_file(BPE)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sZé.,1²日　\xa0<|"), st.characters(codec="utf-8")), max_size=20), st.just("<|endoftext|>")), max_size=3))
def test_ids_are_those_of_the_library(encoder, fresh, texts):
    text = "".join(texts)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_library(encoder, fresh):
    for text in ("x<|endoftext|>", "<|endoftext|>", "a <|endoftext|> b\nc", "a <|endoftext|", "é <|endoftext|><|endoftext|>\n\n"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode("x<|endoftext|>"), "<u4").tolist() == [87, 50256]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=30))
def test_packings_are_whole(counts):
    runs = packing.pack(counts, capacity=64, groups=12)
    got = collections.Counter()
    for filling, times in runs:
        assert times > 0 and sum(filling) <= 64
        for n in filling:
            got[n] += times
    assert got == collections.Counter({k: v for k, v in counts.items() if v})
    taken = collections.Counter()
    for n, rank, _, _ in packing.places(runs).tolist():
        assert rank == taken[n] or rank > taken[n]
        taken[n] = rank


def least_sequences(counts, capacity):
    """Lower bound by Martello and Toth: long pieces need sequences of their own, the others the room that they leave."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - a)
        long = {n: c for n, c in counts.items() if capacity / 2 < n <= capacity - a}
        short = sum(n * c for n, c in counts.items() if a <= n <= capacity / 2)
        room = sum((capacity - n) * c for n, c in long.items())
        best = max(best, alone + sum(long.values()) + max(0, -(-(short - room) // capacity)))
    return best


def test_packings_are_tight():
    rng = random.Random(3)
    for low, high in ((1, 1024), (1, 300), (3, 40)):
        counts = {n: rng.randrange(200) for n in range(low, high)}
        assert sum(t for _, t in packing.pack(counts)) <= 1.02 * least_sequences(counts, 1024) + 1


def test_few_sizes_are_packed_best():
    """50 pairs of 512, 45 triples of 342, 341 and 341, 23 with the other 342; what rounding leaves over costs a few."""
    assert sum(t for _, t in packing.pack({512: 100, 342: 90, 341: 90}, 1024)) <= 121


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(3, 4) == [(0, 3)]


def test_packed_documents(documents, edge_documents):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randrange(0, 400))) for _ in range(120)]
    tokenizer = Tokenizer.from_file(BPE)
    for docs in (documents(*texts), edge_documents):
        rows = packing.packed(docs, BPE, capacity=256, with_ids=True).collect()
        want = collections.Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
            for k, (start, n) in enumerate(packing.cuts(len(ids), 256)):
                part = np.array(ids[start : start + n], "<u4")
                want[r.doc_id, k, start, n, zlib.crc32(part.tobytes()), tuple(part.tolist())] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
        sequences = collections.defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for s in sequences.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 256
    made = packing.sequences(packing.packed(documents("a b", "c"), BPE, with_ids=True)).first()
    assert made.ids.count(2) == 2 and sorted(made.doc_ids) == [0, 1]
    assert packing.packed(documents(), BPE).collect() == []


def test_ranks_are_whole_when_dealt_to_many_parts(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    rows = packing.packed(documents(*["same text"] * 50, *["another text here"] * 30), BPE).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 80


# -- sound files -------------------------------------------------------------------------------------


def test_files_are_lossless(documents, edge_documents):
    for docs in (edge_documents, documents()):
        rows = audio.digests(docs).collect()
        texts = collections.Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
        assert len(rows) == sum(texts.values())
        want = collections.Counter()
        for (i, t), n in texts.items():
            b = t.encode()
            p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
            want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += n
        assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    rows = audio.digests(documents("equal", "equal", "other")).collect()
    assert rows[0][1:] == rows[1][1:] and rows[0].feature != rows[2].feature


def test_other_files_are_refused():
    for data in (b"", b"RIFF", b"x" * 60):
        with pytest.raises(ValueError, match="WAV"):
            audio.samples_of(data)


def test_resampling_matches_the_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500).astype(np.float32)
    got = audio.resampled(x, 0, 250)
    for i in (0, 1, 100, 249):
        at = i * audio.DOWN // audio.UP - audio.TAPS // 2
        want = sum(audio._FILTER[i * audio.DOWN % audio.UP][k] * (x[at + k] if 0 <= at + k < len(x) else 0) for k in range(audio.TAPS))
        assert got[i] == pytest.approx(want, abs=1e-4)
    assert np.allclose(audio.resampled(x, 100, 50), got[100:150], atol=1e-5)


def test_a_tone_stays_in_its_place():
    """Resampled, it is the tone at the other rate, without a shift."""
    rate = audio.RATE * audio.UP / audio.DOWN
    for f in (200, 900, 2000):
        got = audio.resampled(np.sin(2 * np.pi * f * np.arange(3000) / audio.RATE).astype(np.float32), 100, 1000)
        assert np.allclose(got, np.sin(2 * np.pi * f * np.arange(100, 1100) / rate), atol=0.03)
    assert np.abs(audio.resampled(np.sin(2 * np.pi * 5500 * np.arange(3000) / audio.RATE).astype(np.float32), 100, 1000)).max() < 0.1


def slow_features(samples):
    """(log-mel frames, loud frames) by loops over frames, bands and states."""
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    n = -(-len(x) * audio.UP // audio.DOWN)

    def out(i):
        at, phase = divmod(i * audio.DOWN, audio.UP)
        at -= audio.TAPS // 2
        return sum(float(audio._FILTER[phase][k]) * x[at + k] for k in range(audio.TAPS) if 0 <= at + k < len(x))

    top = 2595 * np.log10(1 + audio.RATE * audio.UP / audio.DOWN / 2 / 700)
    edges = [700 * (10 ** (top * k / (audio.MELS + 1) / 2595) - 1) * audio.FRAME * audio.DOWN / audio.UP / audio.RATE for k in range(audio.MELS + 2)]
    mel = []
    for frame in range(1 + n // audio.HOP):
        y = np.array([out(frame * audio.HOP - audio.FRAME // 2 + k) * (0.5 - 0.5 * np.cos(2 * np.pi * k / (audio.FRAME - 1))) for k in range(audio.FRAME)])
        k = np.arange(audio.FRAME)
        power = [abs((y * np.exp(-2j * np.pi * b * k / audio.FRAME)).sum()) ** 2 for b in range(audio.FRAME // 2 + 1)]
        row = []
        for m in range(audio.MELS):
            a, b, c = edges[m : m + 3]
            row.append(10 * np.log10(sum(p * max(0, min((i - a) / (b - a), (c - i) / (c - b))) for i, p in enumerate(power)) + 1e-6))
        mel.append(row)
    energy = [sum(r) / len(r) for r in mel]
    median, loud, state = np.median(energy), [], False
    for e in energy:
        state = e - median >= audio.RISE if not state else e - median >= audio.FALL
        loud.append(state)
    return np.array(mel), loud


def test_features_match_brute_force():
    text = "Some words of a text, and then é" + "ÿ\x00" * 700 + " the quiet end of it " * 60
    samples = audio.payload(text)[0]
    mel, loud = slow_features(samples)
    assert np.allclose(audio.log_mel(samples), mel, atol=0.02)
    table = audio.read(audio.stored(audio.features(samples)))
    assert sum(table["loud_frames"].to_pylist()) == sum(loud) > 0
    tensors = table["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert np.allclose(tensors[: len(mel)], mel, atol=0.03) and (tensors[len(mel) :] == -60).all()
    feature = audio.digest(text)[-1].split(":")
    assert feature[:3] == [str(-(-len(mel) // audio.PATCH)), str(sum(loud)), f"{len(samples) / audio.RATE:.3f}"]


def test_digests_are_of_the_columns(documents):
    """The query's values are those of the stored files and features."""
    docs = documents("a text", None, "another " * 900)
    files = {r.doc_id: r for r in audio.feature_column(audio.media_column(docs)).collect()}
    for r in audio.digests(docs).collect():
        f = files[r.doc_id]
        assert (r.n_bytes, r.media_bytes, r.media_sha256) == (f.n_bytes, len(f.media), hashlib.sha256(f.media).hexdigest())
        assert r.feature.endswith(hashlib.sha256(f.features).hexdigest())


def test_a_tone_is_in_its_band():
    t = np.arange(16_000)
    low, high = (np.uint8(128 + 100 * np.sin(2 * np.pi * f * t / audio.RATE)).tobytes() for f in (300, 3000))
    a, b = (audio.log_mel(x).mean(0).argmax() for x in (low, high))
    assert a < b


def test_long_sounds_are_the_same_in_blocks(monkeypatch):
    data = bytes(random.Random(2).randrange(256) for _ in range(40_000))
    whole = audio.log_mel(data)
    monkeypatch.setattr(audio, "BLOCK", audio.HOP * 7)
    assert np.allclose(audio.log_mel(data), whole, atol=1e-2)


def test_hysteresis():
    levels = np.array([0, 0, 7, 4, 4, 2, 0, 4, 0, 0, 0, 9, 9, 0, 0, 0, 0], dtype=np.float32)
    assert audio.segments(levels[:, None]) == [(2, 5), (11, 13)]


def test_tensors_have_their_spans():
    table = audio.read(audio.stored(audio.features(audio.payload("some text " * 3000)[0])))
    assert table.schema.field("log_mel").type == audio.TENSOR and table.num_rows > 1
    starts, ends = table["start_s"].to_pylist(), table["end_s"].to_pylist()
    assert starts[0] == 0 and all(a <= b for a, b in zip(starts, ends, strict=True)) and starts == sorted(starts)
    assert ends[-1] == 30_016 / audio.RATE


# -- sampled pieces ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁aeé日\x00"), st.characters(codec="utf-8")), max_size=40), st.integers(0, 2**64 - 1))
def test_decoding_gives_the_text(vocabulary, text, key):
    ids = pieces.encode_batch(vocabulary, [text], np.array([key], dtype=np.uint64))[0]
    assert pieces.decode(vocabulary, ids) == text


def test_draws_follow_the_lattice(vocabulary):
    """Frequencies of the segmentations of a word against their weights, counted out."""

    def paths(s):
        if not s:
            yield (), 0.0
        for n in range(1, min(len(s), vocabulary.longest) + 1):
            slot = vocabulary.find(np.array([vocabulary._key(s[:n])], dtype=np.uint64))[0]
            if slot >= 0:
                for p, w in paths(s[n:]):
                    yield (int(vocabulary.id[slot]), *p), w + vocabulary.weight[slot]

    weights = dict(paths("▁there"))
    total = np.logaddexp.reduce(list(weights.values()))
    n = 60_000
    counts = collections.Counter(tuple(i.tolist()) for i in pieces.encode_batch(vocabulary, ["there"] * n, np.arange(n, dtype=np.uint64)))
    assert sum(counts[p] for p in weights) == n
    assert max(abs(counts[p] / n - np.exp(w - total)) for p, w in weights.items()) < 0.01


def test_draws_depend_on_the_row_alone(spark, documents, vocabulary):
    texts = [f"there is something in the {w} of it" for w in ("house", "garden", "water") * 30]
    a = {r.doc_id: r.ids for r in pieces.encoded(documents(*texts), PIECES).collect()}
    b = {r.doc_id: r.ids for r in pieces.encoded(documents(*texts).repartition(7), PIECES).collect()}
    c = {r.doc_id: r.ids for r in pieces.encoded(documents(*texts), PIECES, seed=1).collect()}
    assert a == b != c and len({tuple(a[i]) for i in range(0, len(texts), 3)}) > 3
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(documents(*texts), PIECES), PIECES).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_draws_are_the_same_in_any_batch(vocabulary, monkeypatch):
    """With other texts, in another order, with lattices kept or made again; and drawn one by one."""
    rng = random.Random(12)
    syllables = ("th", "er", "ing", "on", "é", "日", "▁", ".", "\n", " ", " ", "x")
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 200))) for _ in range(300)] + ["y" * 700 + "the" * 300, "there is " * 90]
    keys = np.array([rng.getrandbits(64) for _ in texts], dtype=np.uint64)
    want = [i.tolist() for i in pieces.encode_batch(vocabulary, texts, keys)]
    for few, kept in ((4, 100_000), (0, 0), (10**9, 50)):
        monkeypatch.setattr(pieces, "FEW", few)
        monkeypatch.setattr(pieces, "KEPT_WORDS", kept)
        order = rng.sample(range(len(texts)), len(texts))
        for at in range(0, len(order), 37):
            some = order[at : at + 37]
            got = pieces.encode_batch(vocabulary, [texts[i] for i in some], keys[some])
            assert [i.tolist() for i in got] == [want[i] for i in some]
    assert all(pieces.decode(vocabulary, np.array(i)) == t for i, t in zip(want, texts, strict=True))


def test_long_words_are_filtered_alike(vocabulary, monkeypatch):
    """A word filtered by itself has the sums that it has among others, but for rounding; a very long one takes seconds at most."""
    import time

    words = ["▁" + "there" * 20, "▁" + "somethingé" * 12]
    a = pieces.Lattice(vocabulary)
    a.numbers(words)
    monkeypatch.setattr(pieces, "LONG_WORD", 3)
    b = pieces.Lattice(vocabulary)
    b.numbers(words)
    assert np.allclose(a.sum.all, b.sum.all) and np.array_equal(a.id.all, b.id.all)
    monkeypatch.undo()
    began = time.perf_counter()
    text = "abcdefghij" * 30_000
    assert pieces.decode(vocabulary, pieces.encode_batch(vocabulary, [text], np.array([1], dtype=np.uint64))[0]) == text
    assert time.perf_counter() - began < 20


def test_line_ends_part_words(vocabulary):
    """No piece has a line end among other characters, so cutting there changes no path."""
    assert vocabulary.lines
    for text in ("a b\nc d", "\n", "\n\n a", "a\n▁b", "", "a \n b"):
        assert "".join(pieces.words_of(text, True)).replace("▁", " ") == " " + text.replace("▁", " ")


def test_piece_edges(edge_documents, documents):
    rows = pieces.round_trips(edge_documents, PIECES).collect()
    assert len(rows) == edge_documents.count() and all(r.lossless for r in rows)
    assert pieces.round_trips(documents(), PIECES).collect() == []


# -- licenses ----------------------------------------------------------------------------------------


def slow_scan(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_phrases_match_brute_force(documents, edge_documents):
    rng = random.Random(6)
    vocabulary = "gnu general public license apache mit cc by the MIT License. GNU, CC-BY k İ K é".split(" ")
    texts = [rng.choice((" ", "-", ", ")).join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(150)]
    got = {r.doc_id: tuple(r)[1:6] for r in licenses.scan(documents(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [slow_scan(t) for t in texts]
    rows = licenses.scan(edge_documents).collect()
    assert len(rows) == edge_documents.count() and licenses.scan(documents()).collect() == []
    assert all(r.n_words == slow_scan("word " * 30_000)[0] for r in rows if r.doc_id == 6)


def test_templates_are_found_through_changes(documents):
    """Words put in, left out and changed; a licence without its opening; what is too little."""
    words = licenses.words_in(licenses.MIT)
    changed = ["before"] * 30 + words[:40] + ["inserted", "words"] + words[40:80] + words[81:120] + ["other"] + words[121:] + ["after"]
    body, part = " ".join(words[len(words) * 2 // 5 :]), " ".join(words[:60])
    other = "permission is granted to any person of this and to the software in the software"
    rows = {r.doc_id: r for r in licenses.scan(documents(" ".join(changed), body, part, other, licenses.MIT, licenses.MIT + " x " + licenses.ISC)).collect()}
    assert [rows[i].labels for i in range(6)] == ["mit-text", "mit-text", "", "", "mit-text", "isc,mit-text"]
    assert 0.9 < rows[0].score < 1 and rows[4].score == 1 and 0.3 < rows[2].score < 0.4
    found = [r for r in licenses.spans(documents(" ".join(changed))).collect() if r.label == "mit-text"]
    assert [(r.first_word, r.last_word) for r in found] == [(30, 30 + len(words))]


def test_stray_diagonals_do_not_part_a_span(documents):
    """'the license' stands in the notice several times, so a word put in after one of them leaves strays between the parts."""
    words = licenses.words_in(licenses.APACHE_NOTICE)
    for at in range(8, len(words) - 8):
        text = " ".join([*words[:at], "new", *words[at:]])
        found = [r for r in licenses.spans(documents(text)).collect() if r.label == "apache-2.0" and r.last_word > 40] if at % 16 == 0 else None
        assert found is None or [(r.first_word, r.last_word) for r in found] == [(0, len(words))]


def test_own_templates(documents):
    words = [f"w{i}" for i in range(400)]  # more places than a machine word has bits
    rows = licenses.scan(documents(" ".join(words), " ".join(words[100:350]), " ".join(words[:150])), ((" ".join(words), "own"),)).collect()
    assert sorted((r.doc_id, r.labels, r.score) for r in rows) == [(0, "own", 1.0), (1, "own", 250 / 400), (2, "", 150 / 400)]


def test_long_texts_cost_what_they_hold(documents):
    """Linear in the words: no row copies its text."""
    import time

    took = []
    for n in (100_000, 100_000, 400_000):
        docs = documents(*[" ".join(f"word{i % 9973}" for i in range(n))] * 4)
        began = time.perf_counter()
        assert {r.n_words for r in licenses.scan(docs).collect()} == {n}
        took.append(time.perf_counter() - began)
    assert took[2] < 12 * took[1]


def test_only_ascii_capitals_are_lowered(documents):
    """The Kelvin sign and the dotted capital I are letters of words, but not k and i."""
    texts = ["M\u0130T license", "MIT License", "CC BY \u212a", "apache l\u0130cense"]
    assert sorted((r.doc_id, r.n_words, r.n_base) for r in licenses.scan(documents(*texts)).collect()) == [(0, 2, 0), (1, 2, 1), (2, 3, 1), (3, 2, 0)]


def test_license_scan_is_native(documents):
    plan = licenses.scan(documents("a"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "CartesianProduct"))
