"""Exact similarity join of word n-gram sets by universe partition, and its connected components.

Sets of one size band are cut into segments by hashing the universe of shingles. Two sets with a Jaccard index of
at least the threshold differ in at most H shingles, so with demands T_i on the segments (T_i = 1: equal segments,
T_i = 2: at most one shingle of difference) that add up to H + 1, some segment meets its demand: they share the
hash of that segment, or of it less one shingle. How many segments get T_i = 2 is chosen for each band by cost,
measured on a sample: signatures written, and false partners met. Whatever is chosen finds every pair.

Equal sets are one node from the start. Nodes that share a signature are grouped around the smallest document among
them (a hot group costs one pair for each member, never all pairs). Each node is verified with its nearest pivot first;
these links make a forest. Groups that hold more than one component are searched further, in blocks: parity sketches
(XOR of all shingles' bits; their distance never exceeds the sets') rule pairs out, the rest is verified, new links
merge components, and so on until no pair between components is left. Merging works on the components that new links
touch only, so a round costs what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import discard, filter_place, id_filter, in_filter, lean, mix, sampled, shingles, split_words, stored, texts, word_hashes

WORDS = 3  # words of a shingle
PERCENT = 90
SAMPLE = 4096  # documents that the cost of allocations is measured on
FALSE_PARTNER = 0.05  # cost of a false partner (its sketch is compared), in signatures (written, shuffled, sorted)
SKETCH = 1024  # least bits of a parity sketch; it has at least one for each shingle
SMALL_BLOCK, BLOCK = 2048, 4096  # sets of a group that one task compares with as many others: a 32nd of it, within these
PARTNERS = 4  # pairs that a set proposes in the first round, in a block; each further round brings four times as many
CHUNK = 1 << 17  # shingles handled at once
HANDED = 1 << 16  # signatures that are handed to Spark at once
COMPARED = 4 << 20  # bytes of sketches compared at once
FILTERED = 1 << 26  # documents in groups that a broadcast filter picks (16 bits each, so 128 MB); more are joined
_SALT = np.uint64(0x9E3779B97F4A7C15)


class Bands:
    """Size bands: a set of band b can only be similar to sets of bands b - 1, b and b + 1."""

    def __init__(self, percent: int = PERCENT):
        self.percent, lows = percent, [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, 100 * lows[-1] // percent + 1))
        self.lows = np.array(lows)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def most(self, total: np.ndarray | int) -> np.ndarray | int:
        """Shingles in which similar sets of these sizes together differ at most."""
        return total * (100 - self.percent) // (100 + self.percent)

    def partner(self, size: int) -> int:
        """The largest set that can be similar to one of this size."""
        return 100 * size // self.percent

    def differing(self, band: int) -> int:
        """H: the most that a pair differs whose smaller set is of the band."""
        high = int(self.lows[band + 1]) - 1
        return int(self.most(high + self.partner(high)))


def slack(h: int) -> int:
    """Empty segments with T = 1 that a set may leave out, as its demands add up to more by as many."""
    return int(h >= 6)


def signatures(flat: np.ndarray, owner: np.ndarray, count: int, band: int, h: int, twos: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) for sets given as concatenated shingles, under a band's partition with ``twos`` T = 2."""
    spare = slack(h)
    m = h + 1 + spare - twos
    x = mix(flat + np.uint64((band + 1) * int(_SALT) % (1 << 64)))
    segment = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    key = owner * m + segment
    sums = np.zeros(count * m, np.uint64)
    np.add.at(sums, key, x)
    empty = np.bincount(key, minlength=count * m).reshape(count, m) == 0
    single = empty[:, twos:]
    empty[:, twos:] = single & (single.sum(1) <= spare)[:, None]
    empty[:, :twos] = False
    named = lambda s, i: mix(s + mix((i + 1).astype(np.uint64) * _SALT + np.uint64((band * 64 + 7) * m)))
    index = np.tile(np.arange(m), count)
    keep = ~empty.ravel()
    sets, sigs = np.repeat(np.arange(count), m)[keep], named(sums, index)[keep]
    less = segment < twos
    return np.concatenate([sets, owner[less]]), np.concatenate([sigs, named(sums[key[less]] - x[less], segment[less])])


def all_signatures(hashes: list[np.ndarray], bands: Bands, plan: dict[int, int]) -> list[np.ndarray]:
    """Distinct signatures of each set, under its own band and as the larger partner under the one below."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    band = bands.of(np.maximum(sizes, 1))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.unique(np.concatenate([band, band - 1])):
        if k < 0 or not (h := bands.differing(int(k))):
            continue
        top = bands.partner(int(bands.lows[k + 1]) - 1)
        own = np.flatnonzero((sizes > 0) & ((band == k) | ((band == k + 1) & (sizes <= top))))
        if len(own):
            owner = np.repeat(np.arange(len(own)), sizes[own])
            sets, sigs = signatures(np.concatenate([hashes[i] for i in own]), owner, len(own), int(k), h, plan.get(int(k), 0))
            parts.append((own[sets], sigs))
    if not parts:
        return [np.zeros(0, np.uint64)] * len(hashes)
    sets, sigs = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(sets, kind="stable")
    return np.split(sigs[order], np.cumsum(np.bincount(sets, minlength=len(hashes)))[:-1])


def sketches(hashes: list[np.ndarray]) -> list[bytes]:
    """Parity sketches: bit b is the parity of the shingles that hash to b, modulo a power of two."""
    out = []
    for h in hashes:
        bits = max(SKETCH, 1 << max(0, len(h) - 1).bit_length())
        odd = np.bincount((mix(h ^ _SALT) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return out


def marks(rows: list[bytes]) -> np.ndarray:
    """Sketches of one size as rows of 64-bit words."""
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def folded(m: np.ndarray, width: int) -> np.ndarray:
    """The sketches with fewer bits: the halves' XOR."""
    while m.shape[-1] > width:
        half = m.shape[-1] // 2
        m = m[..., :half] ^ m[..., half:]
    return m


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which sketches differ, pair by pair, at the smaller size of each pair: never more than the sets do."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for x, y in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == (x, y)).all(1))
        width = int(min(x, y)) // 8
        out[rows] = np.bitwise_count(folded(marks([a[k] for k in rows]), width) ^ folded(marks([b[k] for k in rows]), width)).sum(1)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and shingle hashes of documents, about CHUNK words or one document at a time."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, distinct, lengths, index in split_words(batch.column(1), 6 * CHUNK):
            h = word_hashes(distinct)[index]
            yield ids[first : first + len(lengths)], [shingles(x, n) for x in np.split(h, np.cumsum(lengths)[:-1])]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def allocation(docs: DataFrame, bands: Bands, n: int, total: int) -> dict[int, int]:
    """Segments with T = 2 of each band, by measured cost; bands with too few sampled sets keep none.

    False partners of a set grow with the sets there are, so the sample's are scaled to all documents.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _chunks(batches, n):
            band = bands.of(np.maximum([len(x) for x in sets], 1))
            yield pa.RecordBatch.from_arrays([pa.array(band, pa.int64()), _lists(sets)], ["band", "shingles"])

    def measure(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        h = bands.differing(band)
        lists = group.column("shingles").combine_chunks()
        parts = np.split(np.asarray(lists.flatten()).view(np.uint64), np.cumsum(np.asarray(lists.value_lengths()))[:-1])
        sets = [x for x in parts if len(x)]
        sets = list({(len(x), int(x.sum(dtype=np.uint64))): x for x in sets}.values())
        if not h or len(sets) < 8:
            return pa.table({"band": [band], "twos": [0]})
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sketch = sketches(sets)
        best = (np.inf, 0)
        for twos in sorted({0, 1, 2, (h + 1) // 2} & set(range((h + 1) // 2 + 1))):
            who, sigs = signatures(flat, owner, len(sets), band, h, twos)
            order = np.argsort(sigs, kind="stable")
            who, sigs = who[order], sigs[order]
            meet = np.flatnonzero(sigs[1:] == sigs[:-1])  # neighbours in a bucket stand for its pairs
            a, b = who[meet], who[meet + 1]
            false = (distances([sketch[k] for k in a], [sketch[k] for k in b]) > h).sum()
            cost = (len(sigs) + FALSE_PARTNER * 2 * false * max(1.0, total / SAMPLE)) / len(sets)
            best = min(best, (cost, twos))
        return pa.table({"band": [band], "twos": [best[1]]})

    rows = sampled(docs, SAMPLE, total).mapInArrow(lean(sizes), "band bigint, shingles array<bigint>")
    return {r["band"]: r["twos"] for r in rows.groupBy("band").applyInArrow(measure, "band bigint, twos bigint").collect()}


def _set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit hashes of sets, as n x 2 signed numbers."""
    return np.array([[mix(x ^ np.uint64(s)).sum(dtype=np.uint64) for s in (0x51, 0xA7)] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _chunks(batches, n):
            h = _set_hashes(sets)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "n_shingles", "h1", "h2"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint")


def groups_of(docs: DataFrame, bands: Bands, plan: dict[int, int], n: int) -> DataFrame:
    """(pivot, doc_id): who shares a signature with the smallest document that has it.

    Tasks hand on one row for each of their signatures, with all documents that have it, and equal sets once, so
    what many documents share comes in few rows.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sigs, held, seen = [], [], 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            d, s = np.concatenate(docs), np.concatenate(sigs).view(np.int64)
            order = np.lexsort((d, s))
            d, s = d[order], s[order]
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            members = pa.ListArray.from_arrays(pa.array(np.append(start, len(s)).astype(np.int32)), pa.array(d))
            whole = pa.RecordBatch.from_arrays([pa.array(s[start]), members], ["sig", "docs"])
            for k in range(0, whole.num_rows, HANDED):
                yield whole.slice(k, HANDED)

        for ids, sets in _chunks(batches, n):
            keys = [h.tobytes() for h in _set_hashes(sets)]
            fresh = [k for k, key in enumerate(keys) if len(sets[k]) and not (key in seen or seen.add(key))]
            if len(seen) > 2 * CHUNK:
                seen.clear()
            own = all_signatures([sets[k] for k in fresh], bands, plan)
            docs.append(np.repeat(np.array([ids[k] for k in fresh], np.int64), [len(x) for x in own]))
            sigs += own
            held += len(docs[-1])
            if held >= 8 * CHUNK:
                yield from out()
                docs, sigs, held = [], [], 0
        if held:
            yield from out()

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by signature and smallest document: the first of each signature has the pivot."""
        last, pivot = None, 0
        for batch in batches:
            sig, lists = np.asarray(batch.column(0)), batch.column(1)
            if not len(sig):
                continue
            lengths, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
            first = flat[np.cumsum(lengths) - lengths]
            fresh = np.concatenate([[sig[0] != last], sig[1:] != sig[:-1]])
            heads = np.where(fresh, np.arange(len(sig)), -1)
            at = np.maximum.accumulate(heads)
            pivots = np.where(at >= 0, first[np.maximum(at, 0)], pivot)
            last, pivot = sig[-1], pivots[-1]
            p = np.repeat(pivots, lengths)
            pairs = np.unique(np.stack([p, flat], 1)[p != flat], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["pivot", "doc_id"])

    rows = docs.where("doc_id is not null").mapInArrow(lean(local), "sig bigint, docs array<bigint>")
    dealt = rows.repartition("sig").withColumn("low", F.col("docs")[0]).sortWithinPartitions("sig", "low").select("sig", "docs")
    return dealt.mapInArrow(lean(star), "pivot bigint, doc_id bigint").distinct()


def grouped_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, sketch and shingles of the documents in ids (and maybe a few more).

    A filter of ids, broadcast, picks them where they are read; past FILTERED ids the texts are joined with the ids.
    """
    docs, count = docs.where("doc_id is not null"), ids.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sets in _chunks(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sketches(sets), pa.binary()), _lists(sets)], ["doc_id", "n_shingles", "sketch", "shingles"])

    ddl = "doc_id bigint, n_shingles bigint, sketch binary, shingles array<bigint>"
    if count > FILTERED:
        return docs.join(ids, "doc_id", "left_semi").mapInArrow(lean(run), ddl)
    bits = max(20, (16 * count).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids, bits))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, np.asarray(batch.column(2))))).select([0, 1])

    return docs.select("doc_id", "text", filter_place(bits)).mapInArrow(lean(lambda batches: run(chosen(batches))), ddl)


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands, few: bool = False) -> DataFrame:
    """pairs (a, b, ...) with ``linked``, by their shingles; few: the pairs touch few of the sets, which are picked first.

    Where rows repeat a doc_id with other texts, any two texts that hold make a link.
    """
    if few:
        sets = sets.join(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "doc_id", "left_semi")
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.select(*pairs.columns, (100 * common.cast("bigint") >= bands.percent * union).alias("linked"))


def plausible(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out, with the sketches' distance ``near``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = bands.most(np.asarray(batch.column(2)) + np.asarray(batch.column(4)))
            near = distances(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "near"])
            yield rows.filter(pa.array(near <= most))

    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"k_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "k_a", "n_b", "k_b")
    sized = F.abs(F.col("n_a") - F.col("n_b")) * (100 + bands.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - bands.percent)
    return both.where(sized).mapInArrow(lean(run), "a bigint, b bigint, near bigint")


def roots(forest: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up); a node that isn't listed is its own root.

    Pointers are doubled, each to what its target points to. Those whose target points nowhere are done and stay
    where they are stored; the others go on.
    """
    given = stored(forest.select("node", "up", F.lit(True).alias("open")), "pointers")
    steps: list[DataFrame] = []
    while True:
        last = steps[-1] if steps else given
        known = reduce(DataFrame.union, [*(s.where("not open") for s in steps[:-1]), last])
        targets = known.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("open").alias("goes_on"))
        step = last.where("open").select("node", "up").join(targets, "up", "left")
        steps.append(stored(step.select("node", F.coalesce("further", "up").alias("up"), F.coalesce("goes_on", F.lit(False)).alias("open")), "pointers"))
        if not steps[-1].where("open").limit(1).count():
            discard(given)
            return reduce(DataFrame.union, [s.where("not open").select("node", F.col("up").alias("root")) for s in steps])


def merged(edges: DataFrame) -> DataFrame:
    """(node, root) for nodes of edges (a, b) that aren't the smallest of their component.

    Nodes hook onto their smallest neighbour where that is smaller; the edges left between different roots go on.
    """
    forest: list[DataFrame] = []
    ends = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(ends(edges), "edges")
    while edges.limit(1).count():
        hooks = roots(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        forest.append(hooks)
        to = lambda e, c: e.join(hooks.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        left = stored(ends(to(to(edges, "a"), "b")), "edges")
        discard(edges)
        edges = left
    if not forest:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    discard(edges)
    if len(forest) == 1:
        return forest[0]
    out = roots(reduce(DataFrame.union, forest).withColumnRenamed("root", "up"))
    for x in forest:
        discard(x)
    return out


class Sets(NamedTuple):
    """Sets of a block: parallel columns."""

    ids: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    sketches: list[bytes]
    refused: list[list[int] | None]

    def take(self, rows: np.ndarray) -> "Sets":
        return Sets(self.ids[rows], self.labels[rows], self.sizes[rows], [self.sketches[k] for k in rows], [self.refused[k] for k in rows])

    def by_size(self) -> "Sets":
        return self.take(np.argsort(self.sizes, kind="stable"))

    def small_marks(self) -> np.ndarray:
        return np.concatenate([folded(marks([m]), SKETCH // 64) for m in self.sketches])


def refused_codes(x: Sets, y: Sets) -> np.ndarray:
    """Refused pairs (row of x, row of y) as row of x times the rows of y, plus row of y."""
    rows = [k for k, no in enumerate(x.refused) if no]
    if not rows or not len(y.ids):
        return np.zeros(0, np.int64)
    no = np.concatenate([np.asarray(x.refused[k], np.int64) for k in rows])
    owner = np.repeat(rows, [len(x.refused[k]) for k in rows])
    order = np.argsort(y.ids, kind="stable")
    low, high = (np.searchsorted(y.ids[order], no, side) for side in ("left", "right"))
    count = high - low  # more than one where rows repeat an id
    at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(owner, count) * len(order) + order[at]


def comparable(x: Sets, y: Sets, same: bool, bands: Bands, partners: int) -> np.ndarray:
    """Pairs (of x, of y) of different labels that sketches allow and that weren't refused, and the labels.

    Both sides go by size, so that a few rows of x meet one stretch of y; sketches folded to the least size rule out
    most pairs, full ones the rest. Each row of x keeps its nearest ``partners``, so what is held stays in proportion to
    the rows. same: x and y are one block, and each pair is met once.
    """
    x = x.by_size()
    y = x if same else y.by_size()
    out = [np.zeros((4, 0), np.int64)]
    mark_x = x.small_marks()
    mark_y = mark_x if same else y.small_marks()
    width_x, width_y = (np.array([len(m) for m in z.sketches], np.int64) for z in (x, y))
    refused = refused_codes(x, y)
    for k in range(0, len(x.ids), 32):
        rows = slice(k, k + 32)
        lo, hi = np.searchsorted(y.sizes, x.sizes[k] * bands.percent // 100, "left"), np.searchsorted(y.sizes, bands.partner(int(x.sizes[rows][-1])), "right")
        most = bands.most(x.sizes[rows, None] + y.sizes[None, lo:hi])
        can = (x.labels[rows, None] != y.labels[None, lo:hi]) & (np.abs(x.sizes[rows, None] - y.sizes[None, lo:hi]) <= most)
        if same:
            can &= x.ids[rows, None] < y.ids[None, lo:hi]
        if not can.any():
            continue
        small = np.bitwise_count(mark_x[rows, None] ^ mark_y[None, lo:hi]).sum(-1, dtype=np.int64)
        i, j = np.nonzero(can & (small <= most))
        near, i, j = small[i, j], i + k, j + lo
        if len(refused):
            new = ~np.isin(i * len(y.ids) + j, refused)
            near, i, j = near[new], i[new], j[new]
        wide = np.flatnonzero(np.minimum(width_x[i], width_y[j]) > SKETCH // 8)
        step = max(1, COMPARED // int(max(width_x[i[wide]].max(), width_y[j[wide]].max()))) if len(wide) else 1
        for at in (wide[w : w + step] for w in range(0, len(wide), step)):
            near[at] = distances([x.sketches[r] for r in i[at].tolist()], [y.sketches[r] for r in j[at].tolist()])
        good = near <= bands.most(x.sizes[i] + y.sizes[j])
        near, i, j = near[good], i[good], j[good]
        order = np.lexsort((near, i))
        near, i, j = near[order], i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, "left") < partners
        i, j = i[first], j[first]
        out.append(np.stack([x.ids[i], y.ids[j], x.labels[i], y.labels[j]]))
    return np.concatenate(out, 1)


def open_groups(members: DataFrame) -> DataFrame:
    """Groups with more than one label: pivot, top (its most frequent label), major and minor (members with it and without)."""
    counts = members.groupBy("pivot", "label").agg(F.count("*").alias("c"))
    top = F.max(F.struct("c", "label")).alias("top")
    groups = counts.groupBy("pivot").agg(top, F.sum("c").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    return groups.select("pivot", F.col("top.label").alias("top"), F.col("top.c").alias("major"), (F.col("n") - F.col("top.c")).alias("minor"))


def proposals(members: DataFrame, groups: DataFrame, refused: DataFrame | None, sets: DataFrame, bands: Bands, partners: int = PARTNERS) -> DataFrame:
    """(pivot, a, b, label_a, label_b): plausible pairs of one group and two labels, at most ``partners`` of a set in a block, nearest first.

    members: pivot, doc_id, label; groups: as of :func:`open_groups`. A group of more than one block's sets is cut into
    blocks of its most frequent label and blocks of others; two blocks of the frequent label needn't meet.
    """
    n = F.col("major") + F.col("minor")
    size = F.greatest(F.least(n / 32, F.lit(float(BLOCK))), F.lit(float(min(SMALL_BLOCK, BLOCK))))
    whole = n <= size
    cut = groups.select("pivot", "top", F.when(whole, 1).otherwise(F.ceil(F.col("minor") / size)).cast("int").alias("minors"), F.when(whole, 0).otherwise(F.ceil(F.col("major") / size)).cast("int").alias("majors"))
    placed = members.join(cut, "pivot")
    major = (F.col("majors") > 0) & (F.col("label") == F.col("top"))
    h = F.xxhash64("doc_id")
    placed = placed.withColumn("own", F.when(major, F.col("minors") + F.pmod(h, F.col("majors"))).otherwise(F.pmod(h, F.col("minors"))).cast("int"))
    placed = placed.withColumn("last", F.when(major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    placed = placed.join(sets.select("doc_id", "n_shingles", "sketch"), "doc_id")
    if refused is None:
        placed = placed.withColumn("no", F.lit(None).cast("array<bigint>"))
    else:
        both_ways = refused.union(refused.select("b", "a"))
        placed = placed.join(both_ways.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("b").alias("no")), "doc_id", "left")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "label", "n_shingles", "sketch", "no")

    def compare(t: pa.Table) -> pa.Table:
        column = lambda c: np.asarray(t.column(c).combine_chunks())
        i, j, own, labels = int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py()), column("own"), column("label")
        found = np.zeros((4, 0), np.int64)
        if (labels != labels[0]).any() and (i == j or (own == i).any() and (own == j).any()):
            whole = Sets(column("doc_id"), labels, column("n_shingles"), t.column("sketch").to_pylist(), t.column("no").to_pylist())
            x = whole if i == j else whole.take(np.flatnonzero(own == i))
            found = comparable(x, x if i == j else whole.take(np.flatnonzero(own == j)), i == j, bands, partners)
        pivot = np.full(found.shape[1], t.column("pivot")[0].as_py(), np.int64)
        return pa.table([pa.array(pivot), *(pa.array(c.copy()) for c in found)], ["pivot", "x", "y", "label_x", "label_y"])

    found = placed.groupBy("pivot", "i", "j").applyInArrow(compare, "pivot bigint, x bigint, y bigint, label_x bigint, label_y bigint")
    first = F.col("x") < F.col("y")
    turned = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    return found.select("pivot", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), turned("label_x", "label_y").alias("label_a"), turned("label_y", "label_x").alias("label_b"))


def similar_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of each row.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a set holds the distinct n-word shingles, or the whole sequence of
    fewer words. Two documents link if 100 * |intersection| >= percent * |union|. Null, empty and blank texts have no
    shingles and link with nothing. Rows that repeat a doc_id are one document, which links by any of its texts. A null
    doc_id has a null component_id and links with nothing.
    """
    own, bands = texts(docs), Bands(percent)
    plan = allocation(own, bands, n, own.count())
    sets = stored(sets_of(own, n), "sets")
    real = sets.where("n_shingles > 0 and doc_id is not null")
    same = ["h1", "h2", "n_shingles"]
    classes = stored(real.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    # the nodes of documents that aren't their only text's node: mostly copies
    names = stored(real.join(classes, same).select("doc_id", "node").distinct(), "names")
    copies = stored(names.join(names.where("node <> doc_id").select("doc_id").distinct(), "doc_id", "left_semi"), "copies")
    discard(names)
    found = stored(groups_of(own, bands, plan, n), "groups")
    node = lambda g, c: g.join(copies.withColumnRenamed("doc_id", c), c, "left").withColumn(c, F.coalesce("node", c)).drop("node")
    groups = stored(node(node(found, "pivot"), "doc_id").where("pivot <> doc_id").select("pivot", "doc_id").distinct(), "groups")
    discard(found)
    grouped = stored(grouped_sets(own, groups.select("doc_id").union(groups.select("pivot")).distinct(), n), "grouped")
    star = groups.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
    # each node with its nearest pivot only: what that doesn't connect, the search below does
    nearest = stored(plausible(star, grouped, bands).groupBy("b").agg(F.min_by("a", F.struct("near", "a")).alias("a")).select("a", "b"), "nearest")
    done = stored(verified(nearest, grouped, bands), "verified")
    discard(nearest)
    several = copies.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    several = copies.join(several, "doc_id").select("a", F.col("node").alias("b"))  # texts of one document
    forest = [merged(done.where("linked").select("a", "b").union(several))]
    refused, partners, held = done.where("not linked").select("a", "b"), PARTNERS, [groups]
    members = groups.union(groups.select("pivot", F.col("pivot").alias("doc_id"))).distinct().withColumn("label", F.col("doc_id"))
    while True:
        moved = members.join(forest[-1].withColumnRenamed("node", "label"), "label", "left")
        members = stored(moved.select("pivot", "doc_id", F.coalesce("root", "label").alias("label")), "members")
        for x in held:
            discard(x)
        open_ = stored(open_groups(members), "open")
        new = stored(proposals(members, open_, refused, grouped, bands, partners), "proposed")
        held = [members, open_, new]
        if not new.limit(1).count():
            break
        done = stored(verified(new.drop("pivot").distinct(), grouped, bands, True), "verified")
        forest.append(merged(done.where("linked").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))))
        refused = refused.union(done.where("not linked").select("a", "b"))
        # a group that proposed nothing is done: links and refusals only take pairs away
        members = members.join(new.select("pivot").distinct(), "pivot", "left_semi")
        partners *= 4
    for x in held:
        discard(x)
    discard(grouped)
    labels = roots(reduce(DataFrame.union, forest).withColumnRenamed("root", "up"))
    for x in (copies, *forest):
        discard(x)
    named = classes.join(labels, "node", "left").select(*same, F.coalesce("root", "node").alias("component"))
    out = sets.select("doc_id", "n_shingles", "h1", "h2").join(named, same, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows without doc_id all stay.
    """
    found = similar_components(docs, n, percent)
    lost = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
    return kept
