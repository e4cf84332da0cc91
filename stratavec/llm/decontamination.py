"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

A mask reads some positions of a ten-word window and ignores the others, so a window whose words differ only
there has the same hash. The four masks together hit every 20-word overlap with at most four differing words, and
with the two masks for short items every item of 8 words or more of which a fifth differs (a test enumerates them). Hashes
of the benchmark's windows are joined with those of the documents' windows; each hit names an item and a diagonal, on
which the longest stretch that agrees well enough is sought. Where words repeat, windows in a row have one hash: of a
run of hits along a diagonal only the first is kept, and hits are joined in slices of bounded size.
The benchmark is taken in blocks of bounded size, so what is broadcast is bounded; each block reads all
documents once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import WordHashes, lean, mix, texts

MASKS = ("1101010011", "1000101111", "1111100001", "1101011001")
SHORT_MASKS = ("111011", "1100111")  # for items of up to SHORT words, which MASKS don't hit with a fifth differing
SHORT = 15
MIN_WORDS = 20  # words of an overlap, or all of a shorter item
MIN_ITEM = 8  # items of fewer words identify nothing
AGREEMENT = 0.8
BLOCK_WORDS = 4_000_000  # benchmark words that are broadcast at once
CHUNK_WORDS = 1 << 16
JOINED = 1 << 21  # pairs of windows that are held at once (or those of one document window)
CELLS = 1 << 22  # words of diagonals that are compared at once
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BITMAP = 24
_BETWEEN = np.uint64(0x5851F42D4C957F2D)


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits (all non-ASCII counts as such), lower-cased."""
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


def window_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window under the mask."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2), np.uint64)
    for k, read in enumerate(mask):
        if read == "1" and n > 0:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def repeats(w: np.ndarray) -> np.ndarray:
    """Which elements equal the one before."""
    out = np.zeros(len(w), bool)
    out[1:] = w[1:] == w[:-1]
    return out


@dataclass
class Index:
    """Windows of a block of the benchmark: sorted hashes, the item and position of each, a bitmap to pre-filter.

    follows: the window before it in the item has the same hash.
    """

    ids: np.ndarray
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    follows: np.ndarray
    bitmap: np.ndarray
    masks: tuple[str, ...]


def build(rows: list[tuple[int, str]]) -> Index:
    hashed = WordHashes()
    items = [(i, hashed.of(words(t))) for i, t in rows]
    items = [(i, h) for i, h in items if len(h) >= MIN_ITEM]
    masks = (*MASKS, *(SHORT_MASKS if any(len(h) <= SHORT for _, h in items) else ()))
    parts = []
    for k, (_, h) in enumerate(items):
        for mask in masks if len(h) <= SHORT else MASKS:
            w = window_hashes(h, mask)
            parts.append((w, np.full(len(w), k, np.int64), np.arange(len(w)), repeats(w)))
    hashes, item, at, follows = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    order = np.argsort(hashes, kind="stable")
    bitmap = np.zeros(1 << _BITMAP, bool)
    bitmap[(hashes >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
    return Index(np.array([i for i, _ in items], np.int64), [h for _, h in items], hashes[order], item[order], at[order], follows[order], bitmap, masks)


def agrees(equal: np.ndarray, share: float = AGREEMENT) -> bool:
    """At least this share is True."""
    return int(equal.sum()) * 1000 >= round(share * 1000) * len(equal)


def longest_agreement(equal: np.ndarray, share: float = AGREEMENT) -> tuple[int, int]:
    """Start and end of the first longest stretch in which at least this share is True, with True at both ends."""
    true = np.flatnonzero(equal)
    if not len(true):
        return 0, 0
    scale = round(share * 1000)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - scale, -scale))])
    low = np.minimum.accumulate(total)
    ends = true + 1
    # the first start whose prefix sum is not above the end's, and from there the first True
    starts = true[np.searchsorted(true, np.searchsorted(-low, -total[ends], "left"))]
    k = int((ends - starts).argmax())
    return int(starts[k]), int(ends[k])


def _diagonals(index: Index, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(document, item, diagonal) of all hits, distinct and sorted."""
    parts = [np.zeros((0, 3), np.int64)]
    for mask in index.masks:
        w = window_hashes(flat, mask)
        hit = np.flatnonzero(index.bitmap[(w >> np.uint64(64 - _BITMAP)).astype(np.int64)])
        if not len(hit) or not len(index.hashes):
            continue
        a, b = np.searchsorted(index.hashes, w[hit], "left"), np.searchsorted(index.hashes, w[hit], "right")
        doc = np.searchsorted(ends, hit, "right")
        real = (b > a) & (hit + len(mask) < ends[doc])
        hit, doc, a, b = hit[real], doc[real], a[real], b[real]
        # a hit that follows one on the same diagonal is left out: only firsts of runs of the item can be new then
        again = repeats(w)[hit] & (hit > starts[doc])
        first = np.flatnonzero(~index.follows)
        a_new, b_new = np.where(again, np.searchsorted(first, a), a), np.where(again, np.searchsorted(first, b), b)
        held = np.cumsum(b_new - a_new)
        done = 0
        while done < len(hit):
            end = max(done + 1, int(np.searchsorted(held, (held[done - 1] if done else 0) + JOINED, "right")))
            own, count = slice(done, end), (b_new - a_new)[done:end]
            entry = np.repeat(a_new[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            through = np.repeat(again[own], count)
            entry[through] = first[entry[through]]
            rows = np.stack([np.repeat(doc[own], count), index.item[entry], np.repeat((hit - starts[doc])[own], count) - index.at[entry]], 1)
            parts.append(np.unique(rows, axis=0))
            done = end
    return np.unique(np.concatenate(parts), axis=0)


def matches(index: Index, hashes: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, start in document, start in item, words, equal words): the longest overlap of each pair.

    Of equally long ones that with the most equal words counts, then the smallest start in the document less that in
    the item, then the first.
    """
    gap = np.array([_BETWEEN])
    flat = np.concatenate([x for h in hashes for x in (h, gap)]) if hashes else np.zeros(0, np.uint64)
    ends = np.cumsum([len(h) + 1 for h in hashes])
    starts = ends - [len(h) + 1 for h in hashes]
    out, found = [], _diagonals(index, flat, starts, ends)
    cuts = np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(1)) + 1
    for own in np.split(found, cuts) if len(found) else ():
        doc, item = own[0, :2].tolist()
        best = longest_overlap(hashes[doc], index.items[item], own[:, 2])
        if best:
            out.append((doc, item, *best))
    return out


def longest_overlap(d: np.ndarray, t: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int, int] | None:
    """Start in d, start in t, words and equal words of the best overlap of d and t on the diagonals (rising), if any.

    Diagonals on which the same words agree are looked at once: where words repeat, most do.
    """
    best, short = (0, 0, 0, 0), len(t) <= MIN_WORDS
    least, step = min(MIN_WORDS, len(t)), max(1, CELLS // len(t))
    places = np.arange(len(t))
    for k in range(0, len(diagonals), step):
        own = diagonals[k : k + step]
        if short:  # all of the item or nothing
            own = own[(own >= 0) & (own + len(t) <= len(d))]
        at = own[:, None] + places
        equal = (d[np.clip(at, 0, len(d) - 1)] == t) & (at >= 0) & (at < len(d))
        _, firsts = np.unique(np.packbits(equal, axis=1), axis=0, return_index=True)
        firsts = np.sort(firsts)
        for row in firsts[equal[firsts].sum(1) * 1000 >= round(AGREEMENT * 1000) * least]:
            e = equal[row]
            a, b = longest_agreement(e) if not short else (0, len(t) if agrees(e) else 0)
            new = (b - a, int(e[a:b].sum()))
            if b - a >= least and new > best[2:]:
                best = (int(own[row]) + a, a, *new)
        if best[2:] == (len(t), len(t)):
            break
    return best if best[2] else None


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``most`` words, each collected by itself."""
    own = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    total = own.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    n = -(-total // most) or 1
    for k in range(n):
        yield [tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()]


def _chunks(batches: Iterator[pa.RecordBatch], column: int, hashed: WordHashes) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with their documents' word hashes, of bounded size (or one document)."""
    for batch in batches:
        start, held, own = 0, 0, []
        for k in range(batch.num_rows):
            own.append(hashed.of(words(batch.column(column)[k].as_py())))
            held += len(own[-1])
            if held >= CHUNK_WORDS:
                yield batch.slice(start, k + 1 - start), own
                start, held, own = k + 1, 0, []
        if own:
            yield batch.slice(start), own


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each pair of a document and a benchmark item that overlap: doc_id, item_id, doc_start, item_start, n_words, n_equal.

    An overlap is a stretch without insertions of at least MIN_WORDS words, equal at both ends, of which at least
    AGREEMENT are equal; of an item of up to MIN_WORDS words it is all of the item, with differing words anywhere.
    The longest is reported, in words. Items under MIN_ITEM words never match. Null texts and items have no words.
    Repeated rows are reported each.
    """
    own, out = texts(docs), None
    ddl = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint, n_equal bigint"
    for rows in blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(build(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashed = WordHashes()
            for batch, hashes in _chunks(batches, 1, hashed):
                got = matches(shared.value, hashes)
                ids = batch.column(0).to_pylist()
                columns = list(zip(*((ids[d], int(shared.value.ids[i]), *rest) for d, i, *rest in got))) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in ddl.split(", ")])

        part = own.mapInArrow(lean(run), ddl)
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns, without the documents that overlap with a benchmark item. No shuffle."""
    at = docs.columns.index("text")
    for rows in blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(build(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashed = WordHashes()
            for batch, hashes in _chunks(batches, at, hashed):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(shared.value, hashes)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
