import numpy as np

from stratavec.llm import toxicity as t

FILL = "the river runs by a quiet house and nobody saw where birds went today".split()


def sentence(rng, *extra):
    ws = [*rng.choice(FILL, 12), *extra]
    rng.shuffle(ws)
    return " ".join(ws) + "."


def corpus(rng, n=600):
    """Abuse mentions groups more often than neutral text does: the bias that swaps must undo."""
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        group = [rng.choice(["muslim", "women", "gay"])] if rng.random() < (0.8 if toxic else 0.05) else []
        rows.append((sentence(rng, *group, *([rng.choice(["scumbag", "filthy"])] if toxic and rng.random() < 0.9 else [])), int(toxic)))
    return rows


def test_swaps_lower_scores_of_neutral_mentions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(corpus(rng), "text string, toxic int")
    with_swaps = t.fit(rows)
    monkeypatch.setattr(t, "swapped", lambda *a, **k: [])
    without = t.fit(rows)
    neutral = ["A muslim lives by the river.", "Women saw birds.", "The gay house today."]
    assert all(with_swaps.score(x) < 0.3 and with_swaps.score(x) < without.score(x) for x in neutral)
    assert with_swaps.score("what a scumbag") > 0.5 > 0.3 > with_swaps.score("the river runs")


def test_penalty_gradient():
    w, _ = t.train([[0], [1], [0, 1], []], np.array([1.0, 0.0, 1.0, 0.0]), [([0], [1])], 2, penalty=1e4)
    assert abs(w[0] - w[1]) < 0.05


EDGES = [(1, None), (2, ""), (2, ""), (None, "scumbag"), (3, "scumbag " * 100_000), (4, "!!!")]


def test_edges(spark):
    rng = np.random.default_rng(3)
    model = t.fit(spark.createDataFrame(corpus(rng), "text string, toxic int"))
    docs = spark.createDataFrame([(d, x, "s") for d, x in EDGES], "doc_id bigint, text string, score string")
    got = sorted([(r.doc_id, r.score > 0.5) for r in t.score(docs, model).collect()], key=str)
    assert got == sorted([(1, False), (2, False), (2, False), (None, True), (3, True), (4, False)], key=str)
    none = t.fit(spark.createDataFrame([], "text string, toxic int"))
    assert none.score("anything") < 1e-6


def test_training_rows(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(5, 0, 1), (7, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(k, f"text {k}", 9) for k in range(40)], "doc_id bigint, text string, toxic int")
    got = t.training_rows(docs, labels).collect()
    ids = [r.doc_id for r in got]
    held = {r.doc_id for r in docs.where(t.remainder(4) == 2).collect()}
    assert set(ids) == set(range(40)) - held and len(ids) == len(set(ids)) and all(r.toxic == r.doc_id % 2 for r in got)


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    out = t.score(docs, t.fit(t.training_rows(docs, labels))).join(labels, "doc_id").where(t.remainder(4) == 2).collect()
    hit, said, true = sum(r.score >= 0.3 and r.toxic == 1 for r in out), sum(r.score >= 0.3 for r in out), sum(r.toxic == 1 for r in out)
    assert hit >= 0.8 * true and hit >= 0.9 * said


def plain_words(text):
    out, word = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalnum() and not c.isdecimal():
            word += c
        elif word:
            out.add(word)
            word = ""
    return out


def test_scores_match_plain_loops(spark):
    rng = np.random.default_rng(3)
    model = t.fit(spark.createDataFrame(corpus(rng), "text string, toxic int"))
    rows = [(k, x) for k, (x, _) in enumerate(corpus(rng, 50))] + [(100, None), (101, ""), (102, "Scumbag_42 scumbag, WOMEN's filthy?! ünd muslim9women"), (103, "filthy " * 10_000)]
    got = {r.doc_id: r.score for r in t.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), model).collect()}
    for k, x in rows:
        z = model.bias
        for w in plain_words(x):
            if w in model.vocabulary:
                z += model.weights[model.vocabulary[w]]
        assert abs(got[k] - 1 / (1 + np.exp(-min(30, max(-30, z))))) < 1e-9


def test_training_matches_plain_loops():
    """A few steps of the descent, with every term of the loss written out."""
    bags, labels, pairs, times = [[0, 2], [1], [0, 1], []], [1.0, 0.0, 1.0, 0.0], [([0], [1]), ([1, 2], [0])], [3.0, 1.0]
    w, bias = t.train(bags, np.array(labels), pairs, 3, 2.0, 4, np.array(times))
    repeated, b2 = t.train(bags, np.array(labels), [pairs[0]] * 3 + [pairs[1]], 3, 2.0, 4)
    assert np.allclose(w, repeated) and np.isclose(bias, b2)
    theta, first, second = [0.0, 0.0, 0.0, 0.0], [0.0] * 4, [0.0] * 4
    for step in range(1, 5):
        g = [2 * t.RIDGE * theta[k] for k in range(3)] + [0.0]
        for bag, y in zip(bags, labels):
            p = 1 / (1 + np.exp(-(sum(theta[k] for k in bag) + theta[3])))
            for k in [*bag, 3]:
                g[k] += (p - y) / 4
        for (a, b), c in zip(pairs, times):
            change = sum(theta[k] for k in a) - sum(theta[k] for k in b)
            for k in a:
                g[k] += 2.0 * c * 2 * change / 4
            for k in b:
                g[k] -= 2.0 * c * 2 * change / 4
        for k in range(4):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g[k], 0.999 * second[k] + 0.001 * g[k] ** 2
            theta[k] -= 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    assert np.allclose([*w, bias], theta)


def test_pairs_do_not_depend_on_dealing(spark):
    rows = corpus(np.random.default_rng(5), 200)
    a, b = (t.fit(spark.createDataFrame(rows, "text string, toxic int").repartition(n)) for n in (1, 5))
    assert a.vocabulary == b.vocabulary and np.allclose(a.weights, b.weights, atol=1e-6)
