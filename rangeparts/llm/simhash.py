"""Near-duplicate groups by SimHash, found through one-wildcard segment variants.

Two fingerprints that differ in at most four bits agree, but for one bit at most, in one of three
segments (four differences over three segments: some segment gets at most one). Each fingerprint
is indexed under its segments with one bit left out, for every bit; those that share such a
variant are compared exactly. With more segments, keys are made of several of them: that costs
more keys a fingerprint and makes each of them more selective (see ``plan_masks``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeparts.llm.common import cut, met

BITS = 64
MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that one task compares with each other at once.
BLOCK = 4096
#: Bits by which the keys of finer masks are longer, at least.
FINER = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()] if len(words) > shingle else [0]
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) > shingle else [len(whole)]
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=">u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def plan_masks(n: int, max_bits: int = MAX_BITS, bits_over: int = 0) -> list[int]:
    """Bit masks of the variants, all exact for ``max_bits``, chosen by the number of fingerprints.

    ``s`` segments, ``m`` of them in a key: allowed where the ``m`` segments with the fewest
    differences can't have more than one together. The first choice whose keys are selective enough
    that random fingerprints rarely meet is taken, of those with over ``bits_over`` bits in a key;
    there may be none of these.
    """
    choices = []
    for s in range(2, 9):
        for m in range(1, s):
            spread = [max_bits // s + (i < max_bits % s) for i in range(s)]  # the worst case spreads evenly
            if sum(sorted(spread)[:m]) <= 1:
                bits = BITS * m // s - 1
                keys = len(list(itertools.combinations(range(s), m))) * (bits + 1)
                if bits > bits_over:
                    choices.append((keys, bits, s, m))
    if not choices:
        return []
    choices.sort()
    keys, _, s, m = next((c for c in choices if n >> c[1] < 2), choices[-1])
    edges = [round(i * BITS / s) for i in range(s + 1)]
    masks = []
    for chosen in itertools.combinations(range(s), m):
        bits = [b for i in chosen for b in range(edges[i], edges[i + 1])]
        whole = sum(1 << b for b in bits)
        masks += [whole & ~(1 << b) for b in bits]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, max_bits: int, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (of at most max_bits) that connect all of ``fps`` that links connect at all; memory is linear.

    With ``others``, links between the two sets only.
    """
    a, b = [], []
    if others is not None:
        both, side = np.concatenate([fps, others]), np.repeat([0, 1], [len(fps), len(others)])
    else:
        both, side = fps, None
    left = np.arange(len(both))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(both[left] ^ both[at]) <= max_bits
            if side is not None:
                near &= side[left] != side[at]
            found = left[near]
            left = left[~near]
            queue += found.tolist()
            a.append(np.full(len(found), both[at]))
            b.append(both[found])
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _first_key(x: np.ndarray, masks: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether k is the first of the masks under which the two sides of each x agree."""
    first = np.full(len(x), len(masks))
    for i in range(len(masks) - 1, -1, -1):
        first[(x & masks[i]) == 0] = i
    return first == k


LINKS = "a long, b long, k int, masked long, block int"


def _link_batches(masks: list[int], max_bits: int, limit: int):
    """Reads fingerprints sorted by variant; gives links, and the rows of variants with over ``limit`` of them.

    A link is given under the first variant that its two ends share and no other. Inside a variant
    with many fingerprints only a spanning forest is given. Both keep what links connect: a link that
    is left out under its first variant has a path there, whose links are in turn under the same or
    an earlier variant.
    """
    table = np.array(masks, dtype=np.uint64)

    def out(a, b, k, masked, block):
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(k, pa.int32()), pa.array(masked, pa.int64()), pa.array(block, pa.int32())],
            ["a", "b", "k", "masked", "block"],
        )

    def linked(a, b, k):
        keep = _first_key(a ^ b, table, k)
        n = int(keep.sum())
        return out(a[keep], b[keep], k[keep].astype(np.int32), np.zeros(n, np.int64), np.full(n, -1, np.int32))

    def whole(k, masked, fp):
        """Variants that are complete."""
        cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (masked[1:] != masked[:-1])])
        sizes = np.diff(np.r_[cuts, len(k)])
        group = np.repeat(np.arange(len(cuts)), sizes)
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, min(8, int(sizes.max(initial=0)))):
            near = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]))
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= max_bits]
            if len(near):
                yield linked(fp[near], fp[near + d], k[near])
        for at, n in zip(cuts[sizes > 8], sizes[sizes > 8], strict=True):
            a, b = _forest(fp[at : at + n], max_bits)
            if len(a):
                yield linked(a, b, np.full(len(a), k[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, masked, fp = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over, given = None, 0  # a variant that is too large, and how many of its rows have been given
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                columns = [np.asarray(batch.column(i)) for i in range(3)]
                k, masked, fp = np.r_[k, columns[0]], np.r_[masked, columns[1]], np.r_[fp, columns[2].view(np.uint64)]
            if not len(k):
                continue
            last = np.flatnonzero((k == k[-1]) & (masked == masked[-1]))[0]  # this variant may go on
            head = len(k) if batch is None else last
            begin = 0
            if over is not None:
                same = int(np.searchsorted(~((k == over[0]) & (masked == over[1])), True))
                begin = min(same, len(k))
                yield out(fp[:begin], fp[:begin], k[:begin], masked[:begin], ((given + np.arange(begin)) // limit).astype(np.int32))
                given += begin
                if begin == len(k):
                    k, masked, fp = k[:0], masked[:0], fp[:0]
                    continue
                over = None
            head = max(head, begin)
            if head > begin:
                yield from whole(k[begin:head], masked[begin:head], fp[begin:head])
            k, masked, fp = k[head:], masked[head:], fp[head:]
            if len(k) > limit and batch is not None:
                over, given = (k[0], masked[0]), len(k)
                yield out(fp, fp, k, masked, (np.arange(len(k)) // limit).astype(np.int32))
                k, masked, fp = k[:0], masked[:0], fp[:0]

    return run


def links(
    prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, masks: list[int] | None = None, copies: int | None = None
) -> DataFrame:
    """(a, b): pairs of different fingerprints in column ``fp`` that differ in at most ``max_bits``.

    Not all such pairs, but enough of them to connect whatever they connect. A variant with more
    than ``block`` fingerprints is compared block against block, by as many tasks as it has pairs of
    blocks, so no task reads more than two blocks of it. That copies a fingerprint once for each
    block; where this would be over ``copies`` times (the keys of the next finer masks, if not given),
    the fingerprints of the variant are linked through those masks instead, which are exact as well.
    """
    masks = masks or plan_masks(prints.count(), max_bits)
    variants = prints.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("k", "mask"))
    variants = variants.select("k", F.col("fp").bitwiseAND(F.col("mask")).alias("masked"), "fp")
    found = cut(
        variants.repartition("k", "masked")
        .sortWithinPartitions("k", "masked")
        .mapInArrow(_link_batches(masks, max_bits, block), LINKS)
    )
    few = found.where("block < 0").select("a", "b")
    many = found.where("block >= 0").select(F.col("a").alias("fp"), "k", "masked", "block")
    if many.isEmpty():
        return few.distinct()
    counts = cut(many.groupBy("k", "masked").agg((F.max("block") + 1).alias("blocks")))
    # a row for each block: no key of the join has more fingerprints than a block
    counts = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.join(counts, ["k", "masked", "block"])
    if finer := plan_masks(1 << BITS, max_bits, masks[0].bit_count() + FINER):
        copies = copies or len(finer)
        deep = cut(many.where(F.col("blocks") > copies).select("fp").distinct())
        if not deep.isEmpty():
            few = few.unionByName(links(deep, max_bits, block, finer, copies))
            many = many.where(F.col("blocks") <= copies)
    cells = many.select("k", "masked", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select(
        "k", "masked", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def compare(pdf):
        import pandas as pd

        fp = pdf["fp"].to_numpy().view(np.uint64)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        mine = (pdf["block"] == i).to_numpy()
        a, b = _forest(fp[mine], max_bits) if i == j else _forest(fp[mine], max_bits, fp[~mine])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return few.unionByName(cells.groupBy("k", "masked", "i", "j").applyInPandas(compare, "a long, b long")).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it is connected with.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds
    that grows with the logarithm of the size; each round is written to the shared checkpoint folder.
    A node with very many neighbours gets its least one without a shuffle (see ``met``).
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = _state(now)
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("times"))
        large = met(both.where("v > u"), least, "u", 2 * size[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = met(large, least, "u", 2 * size[0]).select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u <> v").distinct())
        size, before = _state(now), size
        if size == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, any others).

    component_id is the smallest doc_id that links of at most ``max_bits`` reach, the row's own
    included. A null or empty text has fingerprint zero and is linked like any other. Equal texts,
    and rows given twice, share a fingerprint and so a component. A row without a doc_id gets the
    smallest id of the others in its component, null if none has one. No rows give no rows.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")))
    n, rows = classes.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    roots = components(links(classes.select("fp"), max_bits, block, plan_masks(n, max_bits)))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "rep", "times", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("times"))
    groups = cut(met(rooted.withColumnRenamed("times", "copies"), least, "root", n))
    groups = groups.select("fp", "component_id", F.col("copies").alias("times"))
    return met(prints, groups, "fp", rows).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; columns as they were.

    Rows given twice under one doc_id stay as they are given, a row without a doc_id stays.
    """
    found = near_duplicates(docs, max_bits)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
