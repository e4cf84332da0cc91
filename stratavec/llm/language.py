"""Language identification with bit-sliced Bloom filters of character n-grams.

Each row of the filter table is a bitmask of languages; an n-gram's mask is the AND of its rows, so one probe
answers for all languages at once. A text's score for a language is how many of its n-grams carry the bit,
corrected for the bits that chance sets: the share of the language's bit among all rows, to the power of the
number of rows probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import discard, lean, mix, remainder, stored, texts

SIZES = (2, 3, 4)  # n-gram lengths
ROWS = 1 << 20
PROBES = 3
FIT_DOCUMENTS = 6000  # documents of a language that the filters are fitted on, about
LEAST_SHARE = 2e-6  # of a language's n-grams that one must have: so at most 500,000 are kept
LEAST_RATIO = 0.1  # of the n-gram's share in the language where it is most common
CHUNK_CHARS = 1 << 19


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter; a space for what isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def letter_stream(given: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single spaces between words, and where each text starts in it.

    Every text is led by a space; so n-grams see its first word's start, and its last word's end.
    """
    raw = np.frombuffer("".join(f"\n{t}" for t in given).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in given])])[:-1]
    low = letters()[np.minimum(raw, 0x10FFFF)]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[begins] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[begins]


def ngrams(stream: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each place, and whether it has a letter and no doubled space."""
    size = max(0, len(stream) - n + 1)
    out, blank = np.full(size, n, np.uint64), np.zeros(size, np.int8)
    for k in range(n):
        c = stream[k : k + size]
        out = out * np.uint64(0x9E3779B97F4A7C15) + c
        blank += c == 32
    doubled = np.zeros(size, bool)
    for k in range(n - 1):
        doubled |= (stream[k : k + size] == 32) & (stream[k + 1 : k + 1 + size] == 32)
    return mix(out), (blank < n) & ~doubled


def rows_of(h: np.ndarray, rows: int = ROWS) -> list[np.ndarray]:
    """The table rows that an n-gram's hash probes."""
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(rows - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Model:
    """languages; for each 64 of them a table of bitmasks; the chance that an absent n-gram carries a bit."""

    languages: list[str]
    tables: list[np.ndarray]
    chance: np.ndarray
    common: str | None  # the language with the most documents

    def score(self, texts: list[str]) -> np.ndarray:
        """Corrected n-gram counts, texts x languages, and the number of n-grams in a last column."""
        stream, begins = letter_stream(texts)
        out = np.zeros((len(texts), len(self.languages) + 1))
        edges = np.append(begins, len(stream))

        def by_text(hit: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
            at = np.minimum(edges, len(hit))
            return total[at[1:]] - total[at[:-1]]

        for n in SIZES:
            h, real = ngrams(stream, n)
            probed = rows_of(h)
            count = by_text(real)
            out[:, -1] += count
            for w, t in enumerate(self.tables):
                mask = t[probed[0]]
                for p in probed[1:]:
                    mask = mask & t[p]
                mask[~real] = 0
                for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                    carried = by_text((mask >> t.dtype.type(k - 64 * w)) & t.dtype.type(1))
                    out[:, k] += np.maximum(0, carried - count * self.chance[k]) / (1 - self.chance[k])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its share of the languages' corrected counts, and the share of n-grams that it knows."""
        lang, share, known = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        real = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        start = 0
        while start < len(real):
            end, held = start, 0
            while end < len(real) and (end == start or held + len(texts[real[end]]) <= CHUNK_CHARS):
                held += len(texts[real[end]])
                end += 1
            scores = self.score([texts[k] for k in real[start:end]])
            own, n = scores[:, :-1], np.maximum(scores[:, -1], 1)
            best, total = own.argmax(1), own.sum(1)
            for j, k in enumerate(real[start:end]):
                lang[k] = self.languages[best[j]] if total[j] > 0 else self.common
                share[k] = float(own[j, best[j]] / total[j]) if total[j] > 0 else 0.0
                known[k] = float(min(1.0, own[j, best[j]] / n[j]))
            start = end
        return lang, share, known


def fit(docs: DataFrame) -> Model:
    """Filters from documents with a language, about FIT_DOCUMENTS of each, chosen by a hash of doc_id.

    docs: doc_id, text, lang; rows with a null or empty text or a null language teach nothing.
    """
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    own = own.where("lang is not null and text <> ''")
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], np.zeros(0), None)
    share = [(F.col("lang") == x) & (F.pmod(F.xxhash64("doc_id", F.lit(977)), F.lit(1 << 20)) < int((1 << 20) * min(1, FIT_DOCUMENTS / n))) for x, n in sizes.items()]
    chosen = own.where(reduce(or_, share))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(lang, []).append(text)
            for lang, held in by.items():
                while held:
                    k, chars = 0, 0
                    while k < len(held) and (not k or chars + len(held[k]) <= CHUNK_CHARS):
                        chars += len(held[k])
                        k += 1
                    stream, _ = letter_stream(held[:k])
                    held = held[k:]
                    for n in SIZES:
                        h, real = ngrams(stream, n)
                        grams, counts = np.unique(h[real], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(grams)), pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), n, np.int32)), pa.array(counts)], ["lang", "h", "n", "c"])

    counts = chosen.select("lang", "text").mapInArrow(lean(count), "lang string, h bigint, n int, c bigint").groupBy("lang", "h", "n").agg(F.sum("c").alias("c"))
    counts = stored(counts, "ngrams")
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("t"))
    share = counts.join(F.broadcast(totals), ["lang", "n"]).withColumn("share", F.col("c") / F.col("t")).where(F.col("share") >= LEAST_SHARE)
    top = share.groupBy("h").agg(F.max("share").alias("top"))
    kept = share.join(top, "h").where(F.col("share") >= LEAST_RATIO * F.col("top")).select("lang", "h")
    tables = bit_tables(kept, languages)
    discard(counts)
    chance = [min(0.999, float(((tables[k // 64] >> tables[k // 64].dtype.type(k % 64)) & tables[k // 64].dtype.type(1)).mean()) ** PROBES) for k in range(len(languages))]
    return Model(languages, tables, np.array(chance), max(languages, key=lambda x: (sizes[x], x)))


def bit_tables(kept: DataFrame, languages: list[str], rows: int = ROWS) -> list[np.ndarray]:
    """The tables of bitmasks, one for each 64 languages, from n-grams' (lang, h).

    Spark sets the bits of :func:`rows_of` and folds them by table row, so at most ``rows`` masks of a table come back.
    """
    numbers = kept.sparkSession.createDataFrame(list(zip(languages, range(len(languages)))), "lang string, k int")
    low = lambda c: c.bitwiseAND(F.lit(rows - 1))
    step = low(F.shiftrightunsigned("h", 40).bitwiseOR(F.lit(1)))
    places = F.explode(F.array(*[low(low(F.col("h")) + n * step) for n in range(PROBES)])).alias("row")
    bits = kept.join(F.broadcast(numbers), "lang").select((F.col("k") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, k % 64)").alias("bit"), places)
    folded = bits.groupBy("word", "row").agg(F.bit_or("bit").alias("mask")).toPandas()
    kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= n or n == 64)
    tables = [np.zeros(rows, kind) for _ in range(-(-len(languages) // 64))]
    for word, t in enumerate(tables):
        own = folded[folded["word"] == word]
        t[own["row"].to_numpy(np.int64)] = own["mask"].to_numpy(np.int64).view(np.uint64).astype(kind)
    return tables


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may teach: crc32(doc_id as text) mod 3 is not 1."""
    return docs.where(remainder(3) != 1)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the corrected counts) and known (share of the text's n-grams).

    ``und`` for a null text, one without a letter, or a model without languages. Each row by itself: repeated
    rows and null doc_ids are kept. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, share, known = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(known, pa.float64())], ["doc_id", "lang_pred", "score", "known"])

    return texts(docs).mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double, known double")


#: Documents are rejected if the best language knows a smaller share of their n-grams.
LEAST_KNOWN = 0.2


def accepted(docs: DataFrame, model: Model, least_known: float = LEAST_KNOWN) -> DataFrame:
    """docs, all columns, without those in no learned language: ``und``, or too few known n-grams."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, known = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" and k >= least_known for x, k in zip(lang, known)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
