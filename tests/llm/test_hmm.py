import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratavec.llm import hmm
from stratavec.llm.common import remainder

RNG = np.random.default_rng(0)


def model(k=3, c=5):
    rows = lambda *shape: RNG.dirichlet(np.ones(shape[-1]), shape[:-1] or None)
    return hmm.Model(rows(k), rows(k, k), rows(k, c).T.copy())


def by_paths(m, x):
    """Likelihood and expected counts by summing over all paths of states."""
    total, k = 0.0, m.states
    start, moves, classes = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for path in itertools.product(range(k), repeat=len(x)):
        p = m.start[path[0]] * math.prod(m.trans[a, b] for a, b in zip(path, path[1:])) * math.prod(m.emit[c, s] for c, s in zip(x, path))
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for c, s in zip(x, path):
            classes[c, s] += p
    return total, start / total, moves / total, classes / total


def test_forward_backward():
    m = model()
    xs = [RNG.integers(0, 5, n) for n in (1, 4, 6, 2, 6, 1)]
    likely, counts = hmm.forward(m, xs, True)
    want = [by_paths(m, x) for x in xs]
    assert np.allclose(likely, np.log([w[0] for w in want]))
    for got, k in zip(counts, (1, 2, 3)):
        assert np.allclose(got, sum(w[k] for w in want))


def test_scaling_changes_nothing(monkeypatch):
    """Long and short sequences, scaled at every step and every few, against a recursion of one sequence at a time."""
    m = model(4, 30)
    xs = [RNG.integers(0, 30, n) for n in (500, 1, 8, 9, 33, 500, 17, 2)]
    results = []
    for every in (1, 3, hmm.SCALED):
        monkeypatch.setattr(hmm, "SCALED", every)
        results.append(hmm.forward(m, xs, True))
        assert np.allclose(hmm.forward(m, xs)[0], results[-1][0])
    for likely, counts in results:
        for x, got in zip(xs, likely):
            now, total = m.start, 0.0
            for j, c in enumerate(x):
                now = m.emit[c] * (now if j == 0 else now @ m.trans)
                total += math.log(now.sum())
                now = now / now.sum()
            assert np.isclose(got, total)
        assert all(np.allclose(a, b) for a, b in zip(counts, results[0][1]))
        assert np.isclose(counts[1].sum(), sum(len(x) - 1 for x in xs)) and np.isclose(counts[2].sum(), sum(map(len, xs)))


def test_passes_raise_the_likelihood():
    v = hmm.Vocabulary(pa.array([], pa.string()), 0, 0, np.ones(5), np.zeros(5), np.zeros(5))
    hmm_prior, hmm.PRIOR = hmm.PRIOR, 1e-6
    try:
        m, xs, last = model(), [RNG.integers(0, 3 + k % 3, 40) for k in range(20)], -np.inf
        for _ in range(8):
            likely, counts = hmm.forward(m, xs, True)
            assert likely.sum() >= last - 1.0
            last = likely.sum()
            m = hmm.maximised(*counts, v)
    finally:
        hmm.PRIOR = hmm_prior


TEXTS = [(k, " ".join(RNG.choice(["the", "of", "Le", "la", f"rare{k}"], 12))) for k in range(60)] + [(100, None), (101, ""), (102, "The\tTHE\x0bof  never seen"), (102, "The\tTHE\x0bof  never seen"), (None, "la la"), (103, "la " * 40_000)]


def reference(docs, train, m, v):
    """Counts and scores of every text by plain loops."""
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for t in train for w in toks(t))
    n, distinct = sum(c.values()), len(c)
    place = {w.encode(): k for k, w in enumerate(v.heavy.to_pylist())}
    of = lambda w: place.get(w, len(place) + hmm.zlib.crc32(w) % hmm.BUCKETS)
    rare = Counter()
    kinds = Counter()
    for w, k in c.items():
        if w not in place:
            rare[of(w)] += k
            kinds[of(w)] += 1
    out = []
    for d, t in docs:
        ws = toks(t)
        base = sum(math.log10((c[w] + 1) / (n + distinct + 1)) for w in ws)
        share = sum(math.log10((c[w] + 1) / (rare[of(w)] + kinds[of(w)] + 1)) for w in ws if w not in place)
        now, total = m.start, 0.0
        for j, w in enumerate(ws):
            now = m.emit[of(w)] * (now if j == 0 else now @ m.trans)
            total += math.log10(now.sum())
            now = now / now.sum()
        out.append((d, len(ws), sum(c[w] > 0 for w in ws), round(base, 4), round(total + share, 4)))
    return n, distinct, out


@pytest.mark.parametrize("heavy", [5, 32_768])
def test_score(spark, monkeypatch, heavy):
    monkeypatch.setattr(hmm, "HEAVY", heavy)
    monkeypatch.setattr(hmm, "BLOCK", 300)
    monkeypatch.setattr(hmm, "START_PASSES", 3)
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in TEXTS], "doc_id bigint, text string, score double").repartition(3)
    train = docs.where(remainder(7) != 2)
    m, v, counts = hmm.fit(train, 3, 1)
    n, distinct, want = reference(TEXTS, [r.text for r in train.collect()], m, v)
    assert (v.total, v.distinct) == (n, distinct) and len(v.heavy) <= heavy
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.trans.sum(1), 1)
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in hmm.score(docs, m, v, counts).collect()]
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-3)


def test_passes_agree_with_one_recursion(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BATCH", 100)
    docs = spark.createDataFrame([t for t in TEXTS if t[0] is not None and t[0] < 60], "doc_id bigint, text string").repartition(4)
    v = hmm.vocabulary(hmm.count_words(docs))
    own = pa.RecordBatch.from_arrays([pa.nulls(60), pa.array([r.text for r in docs.collect()])], ["doc_id", "text"])
    ids = next(hmm._sequences([own], v.heavy))
    m = hmm.starting_point(ids, v, 3)
    one = hmm.maximised(*hmm.forward(m, ids, True)[1], v)
    spread = hmm.baum_welch(docs, m, v)
    assert all(np.allclose(a, b) for a, b in ((one.start, spread.start), (one.trans, spread.trans), (one.emit, spread.emit)))


def test_all_documents_make_the_model(spark, monkeypatch):
    """The same model whatever a sample would hold, and passes until the gain is small."""
    docs = spark.createDataFrame([t for t in TEXTS if t[0] is not None and t[0] < 60], "doc_id bigint, text string").repartition(4)
    whole, v, _ = hmm.fit(docs, 3)
    monkeypatch.setattr(hmm, "START_TOKENS", 100, raising=False)
    again = hmm.fit(docs, 3)[0]
    assert all(np.allclose(a, b) for a, b in ((whole.start, again.start), (whole.trans, again.trans), (whole.emit, again.emit)))
    sequences = hmm.numbered(docs, v)
    after, likely = hmm.one_pass(sequences, whole, v)
    assert hmm.one_pass(sequences, after, v)[1] - likely <= hmm.GAIN * v.total


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    m, v, counts = hmm.fit(docs.limit(0))
    rows = hmm.score(docs, m, v, counts).collect()
    assert [(r.n_tokens, r.n_known, r.base_score) for r in rows] == [(3, 0, 0.0)] and math.isfinite(rows[0].score)
    assert hmm.score(docs.limit(0), m, v, counts).count() == 0


def test_held_out_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hmm.score(docs.where(remainder(7) == 2), *hmm.fit(docs.where(remainder(7) != 2))).collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_words():
    rows = [" a  B\tc\x0b\x0c\r\nd ", "", None, "É\u00a0É é", " ", "\x1cx\x1f y\x85z", "end"]
    own = pa.RecordBatch.from_arrays([pa.nulls(len(rows)), pa.array(rows)], ["doc_id", "text"])
    for most in (None, 4):
        got = []
        for e in hmm.encoded(own, most):
            d = e.distinct.to_pylist()
            got += [[d[i].encode() for i in x] for x in np.split(e.index, np.cumsum(e.lengths)[:-1])]
        assert got == [[*(t or "").encode().lower().split(), b""] for t in rows]


def test_every_sequence_is_in_one_recursion():
    rng = np.random.default_rng(5)
    lengths = [*rng.integers(1, 60, 300), 3 * hmm.BATCH, *rng.integers(1, 2000, 300), 7]
    given = [np.full(n, k, hmm.CLASS) for k, n in enumerate(lengths)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in given[k : k + 50]], pa.binary())], ["ids"]) for k in range(0, len(given), 50)]
    for most in (1, 20_000, hmm.HELD):
        got = list(hmm._held(iter(batches), most))
        assert sorted((int(x[0]), len(x)) for own in got for x in own) == [(k, n) for k, n in enumerate(lengths)]
        assert all((x == x[0]).all() for own in got for x in own) and all(len(own) == 1 or sum(map(len, own)) <= hmm.BATCH for own in got)
    assert hmm.HEAVY + hmm.BUCKETS <= np.iinfo(hmm.CLASS).max + 1


def test_moves_of_uneven_sequences():
    rng = np.random.default_rng(6)
    m = hmm.by_chance(hmm.Vocabulary(pa.array([], pa.string()), 100, 9, rng.random(9), np.zeros(9), np.zeros(9)), 3)
    xs = [rng.integers(0, 9, n) for n in (1, 7, 7, 3, 30, 1, 12)]
    whole, parts = hmm.forward(m, xs, True), [hmm.forward(m, [x], True) for x in xs]
    assert np.allclose(whole[0], [p[0][0] for p in parts])
    for got, each in zip(whole[1], zip(*(p[1] for p in parts))):
        assert np.allclose(got, sum(each))
    assert np.isclose(whole[1][1].sum(), sum(len(x) - 1 for x in xs))
