"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words. Labelled sentences with a term for a group of people are copied
with the term swapped for others, and the loss has the squared change of the score between a sentence and
its copy: which group is mentioned then moves the score little, so neutral mentions aren't taken for abuse.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import discard, remainder, sampled, stored, texts

FIT_DOCUMENTS = 30_000  # labelled documents that are learned from, about
VOCABULARY = 4096  # words with a weight
LEAST_DOCUMENTS = 4  # labelled documents that such a word is in
LEAST_CHI = 30.0  # chi-squared statistic of word and label, so that few words pass by chance
SWAPS = 4  # copies of a sentence with an identity term
PENALTY = 4.0  # weight of the squared score changes
RIDGE = 1e-5
THRESHOLD = 0.3

# Words that name groups of people, in English, German, French and Spanish; the last row is neutral.
IDENTITY = """
women men woman man girls boys female male gay straight lesbian bisexual transgender queer homosexual heterosexual
black white asian african european american latino hispanic arab jewish muslim christian hindu buddhist atheist catholic
immigrant immigrants refugee refugees foreigner foreigners mexican chinese indian turkish german french spanish english
blind deaf disabled old young elderly poor rich
frauen männer muslime christen juden ausländer flüchtlinge schwule lesben
femmes hommes musulmans chrétiens juifs étrangers réfugiés homosexuels lesbiennes
mujeres hombres musulmanes cristianos judíos extranjeros refugiados homosexuales lesbianas
people person persons
""".split()

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def swapped(text: str | None, copies: int = SWAPS) -> list[tuple[list[str], list[str]]]:
    """Word lists of the sentences that hold identity terms, each with copies whose terms are others.

    Chance depends on the text alone, so the pairs don't depend on how texts are dealt out.
    """
    out, terms = [], set(IDENTITY)
    rng = np.random.default_rng(zlib.crc32((text or "").encode("utf-8", "surrogatepass")))
    for sentence in _SENTENCE.findall(text.lower()) if text else ():
        ws = _WORD.findall(sentence)
        if not terms.isdisjoint(ws):
            for _ in range(copies):
                out.append((ws, [IDENTITY[rng.integers(len(IDENTITY))] if w in terms else w for w in ws]))
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        v = self.vocabulary
        z = self.bias + sum(self.weights[v[w]] for w in words(text) & v.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sum(weights: np.ndarray, bag: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Score of each row; a bag is (row, word) of all pairs that are present."""
    return np.bincount(bag[0], weights[bag[1]], n)


def train(bags: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, penalty: float = PENALTY, steps: int = 600, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss + ridge + penalty * mean squared score change of the pairs (Adam).

    times: how often each pair counts (once, if not given).
    """
    flat = lambda lists: (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter((w for x in lists for w in x), np.int64))
    own, (left, right) = flat(bags), (flat([p[k] for p in pairs]) for k in (0, 1))
    n, often = len(bags), np.ones(len(pairs)) if times is None else times
    m = max(1.0, often.sum())
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    theta = np.zeros(size + 1)
    theta[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        w = theta[:-1]
        wrong = (1 / (1 + np.exp(-np.clip(_sum(w, own, n) + theta[-1], -30, 30))) - labels) / n
        change = 2 * penalty / m * often * (_sum(w, left, len(pairs)) - _sum(w, right, len(pairs)))
        g = np.bincount(own[1], wrong[own[0]], size) + 2 * RIDGE * w
        g = g + np.bincount(left[1], change[left[0]], size) - np.bincount(right[1], change[right[0]], size)
        g = np.append(g, wrong.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with labels of documents whose crc32(doc_id as text) mod 4 is not 2."""
    own = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    own = own.where((remainder(4) != 2) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = sampled(own, FIT_DOCUMENTS, own.count())
    return texts(docs).join(F.broadcast(own), "doc_id")  # at most about FIT_DOCUMENTS rows of two numbers


def fit(rows: DataFrame) -> Model:
    """From text and toxic (0 or 1) of a bounded number of rows; none gives a model that always says 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for w in words(text):
                    seen.setdefault(w, [0, 0])[toxic] += 1
            yield pd.DataFrame([(w, *c) for w, c in seen.items()], columns=["word", "clean", "toxic"])

    rows = rows.select("text", "toxic")
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    a, b = float(total.get(0, 0)), float(total.get(1, 0))
    if not a or not b:
        return Model({}, np.zeros(0), -30.0 if not b else 30.0)
    found = rows.mapInPandas(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") / b, F.col("clean") / a
    share = (F.col("toxic") + F.col("clean")) / (a + b)
    chi = a * b / (a + b) * (p - q) * (p - q) / (share * (1 - share) + 1e-9)
    best = found.where((F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS) & (chi >= LEAST_CHI)).orderBy(chi.desc(), "word").limit(VOCABULARY)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys([*IDENTITY, *(r["word"] for r in best.collect())]))}

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = lambda ws: {vocabulary[w] for w in ws if w in vocabulary}
        for batch in batches:
            own, pairs = [], Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                own.append((sorted(ids(words(text))), int(toxic), None, None, None))
                for left, right in (map(ids, p) for p in swapped(text)):
                    # what both have cancels out of the change
                    pairs[tuple(sorted(left - right)), tuple(sorted(right - left))] += 1
            own += [(None, None, list(a), list(b), c) for (a, b), c in pairs.items() if a or b]
            yield pd.DataFrame({k: pd.Series([x[j] for x in own], dtype=t) for j, (k, t) in enumerate((("bag", object), ("toxic", "Int64"), ("removed", object), ("added", object), ("times", "Int64")))})

    made = stored(rows.mapInPandas(bags, "bag array<int>, toxic int, removed array<int>, added array<int>, times bigint"), "swaps")
    got = made.where("toxic is not null").select("bag", "toxic").toPandas()  # the bounded sample's known words
    pairs = made.where("toxic is null").groupBy("removed", "added").agg(F.sum("times").alias("times")).orderBy("removed", "added").toPandas()  # distinct swaps of listed terms
    discard(made)
    changes = [(list(a), list(b)) for a, b in zip(pairs["removed"], pairs["added"])]
    weights, bias = train([list(x) for x in got["bag"]], got["toxic"].to_numpy(float), changes, len(vocabulary), times=pairs["times"].to_numpy(float))
    return Model(vocabulary, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of each row; null and empty texts score as no words do.

    Texts are scored whole, however long; rows one by one, repeated ones alike. Other columns take no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, score double")
