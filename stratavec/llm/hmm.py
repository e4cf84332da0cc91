"""A hidden Markov language model, trained by Baum-Welch on the whole corpus.

States emit word classes: each word that is at least one in HEAVY of the corpus is a class of its own (so there are
at most HEAVY), all others share BUCKETS classes by hash and have a count-based share of their class. The model's
size is therefore fixed, while the counts behind it cover every document. Each Baum-Welch pass runs the scaled
forward-backward recursion over every training document; tasks hand on expected counts, which are summed by class.
The first model has the class frequencies of all documents, reweighted by chance for each state; passes go on until
the likelihood hardly gains, in the same way at every size.

A document's score is its exact likelihood by the scaled forward recursion, times the shares of its rare words. The
counts of rare words stay distributed: a task sends each rare word of a block of documents once, with the documents
it is in, joins it with the counts and gets all of a block's words back together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import discard, split_words, stored, texts

STATES = 8
HEAVY = 32_768
BUCKETS = 16_384
CLASS = np.dtype("<u2")  # holds all classes, of which there are at most HEAVY + BUCKETS
GAIN = 0.002  # passes over all training documents go on until the log-likelihood gains no more than this a token
START_PASSES = 20  # passes of starting_point over sequences held at once; fit doesn't use it
LEAN = 0.25  # shape of the gamma weights by which states prefer words at first: the smaller, the further apart
PRIOR = 2_000.0  # tokens' worth of the corpus's own class frequencies that each state has seen
SCALED = 8  # steps between scalings: probabilities of so many tokens together stay far from underflow
BATCH = 1 << 19  # tokens of one recursion (or one document)
HELD = 1 << 21  # tokens of documents whose lengths are sorted together, and one document more
BLOCK = 16 << 20  # bytes of texts that are split and scored together (or one document)


@dataclass
class Encoded:
    """Tokens of consecutive texts: distinct ones (the end is ""), each text's number of them, and all by index."""

    first: int
    distinct: pa.Array
    lengths: np.ndarray
    index: np.ndarray


def encoded(batch: pa.RecordBatch, most: int | None = None) -> Iterator[Encoded]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end, of slices of a batch's texts."""
    for first, distinct, lengths, index in split_words(batch.column(1), most or BLOCK):
        end = pc.index(distinct, "").as_py()
        if end < 0:
            end = len(distinct)
            distinct = pa.concat_arrays([distinct, pa.array([""], distinct.type)])
        lengths = lengths + 1
        out, word = np.full(lengths.sum(), end, np.int32), np.ones(lengths.sum(), bool)
        word[np.cumsum(lengths) - 1] = False
        out[word] = index
        yield Encoded(first, distinct, lengths, out)


@dataclass
class Vocabulary:
    """Classes of words. total: N, distinct: V; log_count and log_bucket: log10(c + 1) and log10(C + V + 1) by class."""

    heavy: pa.Array
    total: int
    distinct: int
    counts: np.ndarray
    log_count: np.ndarray
    log_bucket: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.counts)


def classes_of(distinct: pa.Array, heavy: pa.Array) -> np.ndarray:
    """Class of each word: its place among the heavy ones, or its bucket after them."""
    out = np.asarray(pc.fill_null(pc.index_in(distinct, heavy), -1)).astype(np.int32)
    rare = np.flatnonzero(out < 0)
    out[rare] = [len(heavy) + zlib.crc32(w) % BUCKETS for w in distinct.take(pa.array(rare)).cast(pa.binary()).to_pylist()]
    return out


def count_words(train: DataFrame) -> DataFrame:
    """(token, c) over all training documents, written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in encoded(batch):
                c = np.bincount(e.index, minlength=len(e.distinct))
                yield pa.RecordBatch.from_arrays([e.distinct, pa.array(c)], ["token", "c"])

    return stored(train.mapInArrow(count, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collects the heavy words (at most HEAVY) and the sums of BUCKETS classes."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    heavy = sorted((r["token"], r["c"]) for r in counts.where(F.col("c") * HEAVY >= total).collect()) if total else []
    c = np.zeros(len(heavy) + BUCKETS)
    kinds = np.zeros(len(heavy) + BUCKETS)
    c[: len(heavy)] = [n for _, n in heavy]
    for r in counts.where(F.col("c") * HEAVY < total).groupBy((F.crc32(F.col("token").cast("binary")) % BUCKETS).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        c[len(heavy) + r["b"]], kinds[len(heavy) + r["b"]] = r["c"], r["v"]
    log_count, log_bucket = np.log10(c + 1), np.log10(c + kinds + 1)
    log_count[len(heavy) :], log_bucket[: len(heavy)] = 0, 0
    return Vocabulary(pa.array([w for w, _ in heavy], pa.string()), total, distinct, c, log_count, log_bucket)


@dataclass
class Model:
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # classes x states

    @property
    def states(self) -> int:
        return len(self.start)


def forward(model: Model, ids: list[np.ndarray], backward: bool = False):
    """Natural log-likelihood of each sequence (none empty); with backward also the expected counts.

    Sequences are laid out by time, so that all take a step at once. Each class's emissions are taken relative to its
    largest, and every SCALED steps the states' joint probabilities are scaled to sum 1; the logs of the largest ones,
    of the scales and of the last sum add up to the likelihood. Counts: of starts, of moves between states, and of
    classes by state; each token's are scaled by themselves. The model's number type is used.
    """
    lengths = np.array([len(x) for x in ids])
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # sequences that have a token at each time
    starts = np.concatenate([[0], np.cumsum(alive)])
    edges, ones = starts.tolist(), np.ones(model.states, model.emit.dtype)
    top = model.emit.max(1)
    log_top = np.log(top.astype(float))
    flat = np.empty(edges[-1], np.int32)
    for rank, i in enumerate(order.tolist()):
        flat[starts[: len(ids[i])] + rank] = ids[i]
    emit = (model.emit / top[:, None]).take(flat, axis=0)
    alpha, trans = np.empty_like(emit), np.ascontiguousarray(model.trans)
    logs = np.add.reduceat(log_top[np.concatenate([ids[i] for i in order.tolist()])], np.cumsum(sizes) - sizes)
    np.multiply(emit[: edges[1]], model.start, out=alpha[: edges[1]])
    for t in range(1, len(alive)):
        a, b = edges[t], edges[t + 1]
        now = alpha[a:b]
        np.matmul(alpha[edges[t - 1] : edges[t - 1] + b - a], trans, out=now)
        now *= emit[a:b]
        if not t % SCALED:
            total = now @ ones
            now /= total[:, None]
            logs[: b - a] += np.log(total)
    ends = starts[sizes - 1] + np.arange(len(ids))
    logs += np.log(alpha[ends] @ ones)
    out = np.empty(len(ids))
    out[order] = logs
    if not backward:
        return out, None
    # beta is 1 at every sequence's end; emit becomes emission times beta, shrunk holds the scales of beta
    beta, shrunk, back = np.empty_like(emit), np.ones(len(flat), emit.dtype), np.ascontiguousarray(model.trans.T)
    beta[ends] = 1
    for t in range(len(alive) - 2, -1, -1):
        a, b, c = edges[t], edges[t + 1], edges[t + 2]
        weighted, now = emit[b:c], beta[a : a + c - b]
        weighted *= beta[b:c]
        np.matmul(weighted, back, out=now)
        if not t % SCALED:
            total = now @ ones
            now /= total[:, None]
            shrunk[a : a + c - b] = total
    beta *= alpha
    inverse = 1 / (beta @ ones)
    beta *= inverse[:, None]
    alpha *= (inverse / shrunk)[:, None]
    # a token's predecessor is as many places before it as there were sequences then: alike over runs of steps
    moves, cuts = np.zeros(trans.shape), (np.flatnonzero(np.diff(alive[:-1])) + 2).tolist()
    for t, last in zip([1, *cuts], [*cuts, len(alive)]):
        a, b, back_by = edges[t], edges[last], edges[t] - edges[t - 1]
        moves += alpha[a - back_by : b - back_by].T @ emit[a:b]
    places = flat.astype(np.int64)
    classes = np.stack([np.bincount(places, beta[:, k], len(model.emit)) for k in range(model.states)], 1)
    return out, (beta[: edges[1]].sum(0, dtype=float), model.trans * moves, classes)


def maximised(start: np.ndarray, moves: np.ndarray, classes: np.ndarray, v: Vocabulary) -> Model:
    """The model of expected counts, each state leaning on the corpus's class frequencies."""
    prior = (v.counts + 1) / (v.counts + 1).sum()
    emit = classes + PRIOR * prior[:, None]
    trans = moves + 1.0
    begin = start + 1.0
    return Model(begin / begin.sum(), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))


def _batches(ids: list[np.ndarray]) -> Iterator[list[int]]:
    """Indexes of sequences of similar length, up to BATCH tokens."""
    held, size = [], 0
    for i in sorted(range(len(ids)), key=lambda i: len(ids[i])):
        if held and size + len(ids[i]) > BATCH:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(ids[i])
    if held:
        yield held


def by_chance(v: Vocabulary, states: int, seed: int = 42) -> Model:
    """States that keep to themselves, each with the corpus's class frequencies times weights of its own.

    The weights don't depend on the corpus's size, so neither does how far the states are apart.
    """
    emit = (v.counts + 1)[:, None] * np.random.default_rng(seed).gamma(LEAN, size=(v.classes, states))
    trans = 20.0 * np.eye(states) + 0.01
    return Model(np.full(states, 1 / states), trans / trans.sum(1, keepdims=True), (emit + 1e-9) / (emit + 1e-9).sum(0))


def starting_point(ids: list[np.ndarray], v: Vocabulary, states: int = STATES, seed: int = 42) -> Model:
    """START_PASSES passes over sequences that are held at once."""
    model = by_chance(v, states, seed)
    for _ in range(START_PASSES if ids else 0):
        parts = [forward(model, [ids[i] for i in own], True)[1] for own in _batches(ids)]
        model = maximised(*(sum(p) for p in zip(*parts)), v)
    return model


def _sequences(batches: Iterator[pa.RecordBatch], heavy: pa.Array) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for e in encoded(batch):
            yield np.split(classes_of(e.distinct, heavy)[e.index], np.cumsum(e.lengths)[:-1])


def numbered(train: DataFrame, v: Vocabulary) -> DataFrame:
    """ids: the classes of every document's tokens, 16-bit numbers as bytes: Spark hands them on as they are."""
    shared = train.sparkSession.sparkContext.broadcast(v.heavy)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _sequences(batches, shared.value):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(CLASS).tobytes() for x in own], pa.binary())], ["ids"])

    return train.mapInArrow(ids, "ids binary")


def _held(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[list[np.ndarray]]:
    """Sequences for one recursion each. Of those held, the longest wait for others as long: a step then takes more of them."""
    ids, size = [], 0
    for batch in batches:
        for x in batch.column(0):
            ids.append(np.frombuffer(x.as_buffer(), CLASS))
            size += len(ids[-1])
            if size > most:
                *ready, ids = ([ids[i] for i in own] for own in _batches(ids))
                yield from ready
                ids = [x.copy() for x in ids]  # not their batches with them
                if sum(map(len, ids)) > BATCH:
                    yield ids
                    ids = []
                size = sum(map(len, ids))
    for own in _batches(ids):
        yield [ids[i] for i in own]


def one_pass(sequences: DataFrame, model: Model, v: Vocabulary) -> tuple[Model, float]:
    """One pass over all of :func:`numbered`: expected counts of all tasks, summed by class, then maximised.

    Also the log-likelihood of the model that came in. The recursion's numbers have 32 bits here, sums have 64.
    """
    spark, k = sequences.sparkSession, model.states
    shared = spark.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in (model.start, model.trans, model.emit))))
    names = [f"s{i}" for i in range(k)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total, likely = shared.value, None, 0.0
        for own in _held(batches):
            logs, got = forward(m, own, True)
            likely += logs.sum()
            total = got if total is None else tuple(a + b for a, b in zip(total, got))
        if total:
            start, moves, classes = total
            seen = np.flatnonzero(classes.any(1))
            rows = np.concatenate([np.full((1, k), likely), start[None], moves, classes[seen]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(-2 - k, 0), seen])), *(pa.array(rows[:, i].copy()) for i in range(k))], ["class", *names])

    sums = sequences.mapInArrow(expect, "class bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("class").agg(*(F.sum(n).alias(n) for n in names))
    got = sums.toPandas().set_index("class").reindex(range(-2 - k, v.classes), fill_value=0.0).to_numpy()
    shared.unpersist()
    return maximised(got[1], got[2 : k + 2], got[k + 2 :], v), float(got[0, 0])


def baum_welch(train: DataFrame, model: Model, v: Vocabulary) -> Model:
    """The model after one pass over all training documents."""
    return one_pass(numbered(train, v), model, v)[0]


def fit(train: DataFrame, states: int = STATES, passes: int | None = None) -> tuple[Model, Vocabulary, DataFrame]:
    """Model, vocabulary and word counts of the training documents' texts (doc_id, text), all of them.

    Passes are as many as given, else until one shows that the last has gained GAIN a token or less.
    """
    train = texts(train)
    counts = count_words(train)
    v = vocabulary(counts)
    sequences = stored(numbered(train, v), "classes")
    model, last, done = by_chance(v, states), -np.inf, 0
    while passes is None or done < passes:
        model, likely = one_pass(sequences, model, v)
        done += 1
        if passes is None and not likely - last > GAIN * v.total:
            break
        last = likely
    discard(sequences)
    return model, v, counts


def score(docs: DataFrame, model: Model, v: Vocabulary, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of each row.

    A null or empty text is its end alone. Rows are scored one by one: repeated rows and null doc_ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, v))
    names = ["block", "token", "at", "doc_id", "n_tokens", "n_known", "base_score", "score"]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocab = shared.value
        heavy, number = len(vocab.heavy), TaskContext.get().partitionId() << 32
        for batch in batches:
            for e in encoded(batch):
                n, at = len(e.lengths), np.cumsum(e.lengths) - e.lengths
                classes = classes_of(e.distinct, vocab.heavy)
                flat = classes[e.index]
                ids, likely = np.split(flat, at[1:]), np.empty(n)
                for own in _batches(ids):
                    likely[own] = forward(m, [ids[i] for i in own])[0]
                sums = lambda x: np.add.reduceat(x[flat], at)
                key = pa.array([f" {number} {k}" for k in range(n)])  # with a space: no word's key
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), key, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32))), batch.column(0).slice(e.first, n), pa.array(e.lengths),
                     pa.array(sums((np.arange(vocab.classes) < heavy).astype(np.int64))), pa.array(sums(vocab.log_count)), pa.array(likely / np.log(10) - sums(vocab.log_bucket))], names)
                places = np.flatnonzero(flat >= heavy)
                word, doc = e.index[places], np.repeat(np.arange(n, dtype=np.int32), e.lengths)[places]
                order = np.argsort(word, kind="stable")
                found, times = np.unique(word, return_counts=True)
                where = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32)), pa.array(doc[order]))
                nulls = [pa.nulls(len(found), f) for f in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number)), e.distinct.take(pa.array(found)), where, *nulls], names)
                number += 1

    rows = texts(docs).mapInArrow(block, "block bigint, token string, at array<int>, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    c = counts.where(F.col("c") * HEAVY < v.total)
    joined = rows.join(c, "token", "left").select("block", "at", "doc_id", "n_tokens", "n_known", "base_score", "score", "c")
    unit = float(np.log10(v.total + v.distinct + 1))

    def fold(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at, is_doc = t.column("at").combine_chunks(), ~np.asarray(t.column("n_tokens").is_null())
        where, lengths = np.asarray(at.flatten()), np.asarray(at.value_lengths())
        c_ = np.repeat(np.asarray(t.column("c").fill_null(0)), lengths)
        doc = np.repeat(is_doc, lengths)
        d = t.filter(pa.array(is_doc))
        k, n = where[doc], int(is_doc.sum())
        add = np.bincount(where[~doc], np.log10(c_[~doc] + 1.0), n)[k]
        known = np.bincount(where[~doc], c_[~doc] > 0, n)[k].astype(np.int64)
        n_tokens = np.asarray(d.column("n_tokens"))
        return pa.table({"doc_id": d.column("doc_id"), "n_tokens": pa.array(n_tokens), "n_known": pa.array(np.asarray(d.column("n_known")) + known),
                         "base_score": pa.array(np.asarray(d.column("base_score")) + add - unit * n_tokens), "score": pa.array(np.asarray(d.column("score")) + add)})

    return joined.groupBy("block").applyInArrow(fold, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
