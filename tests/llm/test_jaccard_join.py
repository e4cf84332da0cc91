import itertools

import numpy as np
import pytest

from stratavec.llm import jaccard_join as jj


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def brute(rows, percent=90):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 0.5 < len(x) / len(y) < 2 and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return sorted(((d, len(x), None if d is None else find(d)) for d, x in sets), key=str)


def edited(rng, text, edits):
    w = text.split()
    for k in rng.integers(0, len(w), edits):
        w[k] = f"e{rng.integers(1000)}"
    return " ".join(w)


def rows(seed=0):
    rng = np.random.default_rng(seed)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for n in (1, 2, 3, 9, 11, 12, 20, 40, 90, 150, 300, 700)]
    out = [edited(rng, b, e) for b in base for e in (0, 0, 1, 1, 2, 3, 5, 8, 12)]
    for b in base[3:]:
        w = b.split()
        out += [" ".join(w[: len(w) - k]) for k in (1, 2, 5)] + [" ".join(w * 2)]
    out += [None, "", " \t\n", "x " * 30_000, "A b C d E f G h I j K", "a B c D e F g H i J k"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("twos", [None, 1, 3])
def test_brute(spark, monkeypatch, twos):
    if twos:
        monkeypatch.setattr(jj, "allocation", lambda docs, bands, n, total: {k: min(twos, (bands.differing(k) + 1) // 2) for k in range(200)})
        monkeypatch.setattr(jj, "BLOCK", 5)
        monkeypatch.setattr(jj, "PARTNERS", 1)
    data = rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in data], "doc_id bigint, text string, n_shingles int, h1 string").repartition(4)
    assert sorted(map(tuple, jj.similar_components(df).collect()), key=str) == brute(data)


def test_repeats_and_nulls(spark):
    data = [(3, "a b c d e"), (3, "a b c d e"), (1, "A B c d e"), (None, "a b c d e"), (7, None), (7, None), (9, "q r s t")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = sorted(map(tuple, jj.similar_components(df).collect()), key=str)
    assert got == sorted([(3, 3, 1), (3, 3, 1), (1, 3, 1), (None, 3, None), (7, 0, 7), (7, 0, 7), (9, 2, 9)], key=str)
    assert jj.similar_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_every_similar_pair_shares_a_signature(percent):
    rng, bands = np.random.default_rng(1), jj.Bands(percent)
    for trial in range(300):
        size = int(rng.integers(5, 300))
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        gone, new = rng.integers(0, size // 8 + 1, 2)
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * (len(a) + len(b) - common):
            continue
        plan = {k: min(int(rng.integers(0, 4)), (bands.differing(k) + 1) // 2) for k in range(100)}
        x, y = jj.all_signatures([a, b], bands, plan)
        assert set(x.tolist()) & set(y.tolist()) or set(a.tolist()) == set(b.tolist())
        distance = len(a) + len(b) - 2 * common
        x, y = jj.sketches([a, b])
        assert jj.distances([x], [y])[0] <= distance <= bands.most(len(a) + len(b))


def test_sketches_tell_large_sets_apart():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (900, 1100, 5000, 20_000, 19_000)]
    marks = jj.sketches(sets)
    for i, j in itertools.combinations(range(5), 2):
        d = jj.distances([marks[i]], [marks[j]])[0]
        assert d <= len(sets[i]) + len(sets[j]) and (min(len(sets[i]), len(sets[j])) < 0.7 * max(len(sets[i]), len(sets[j])) or d > 0.2 * (len(sets[i]) + len(sets[j])))
    assert len(marks[3]) == 32768 // 8 and jj.distances([marks[2]], [marks[2]])[0] == 0


def test_merged(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, 101), (100, 102), (5, 102), (7, 7)]
    rng = np.random.default_rng(3)
    edges += [(200, int(k)) for k in rng.permutation(np.arange(150, 190))] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (300, 2))]
    got = {r.node: r.root for r in jj.merged(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert jj.merged(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_roots_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(100)] + [(500, 400)], "node bigint, up bigint")
    assert {r.node: r.root for r in jj.roots(chain).collect()} == {k: 0 for k in range(1, 101)} | {500: 400}


def test_texts_of_one_document_link_together(spark):
    a, b, c = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    data = [(5, a), (5, b), (3, b), (9, a), (7, c), (9, c), (20, "1 2 3 4 5")]
    got = {r.doc_id: r.component_id for r in jj.similar_components(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 3, 20: 20}


def test_joined_texts_as_filtered(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string").repartition(3)
    ids = df.where("doc_id % 3 = 0").select("doc_id")
    few = {(r.doc_id, len(r.shingles)) for r in jj.grouped_sets(df, ids, 3).collect()}
    monkeypatch.setattr(jj, "FILTERED", 0)
    exact = {(r.doc_id, len(r.shingles)) for r in jj.grouped_sets(df, ids, 3).collect()}
    assert exact <= few and {d for d, _ in exact} == {r.doc_id for r in ids.collect()}


def test_refused_pairs_are_not_proposed_again(spark, monkeypatch):
    """Pairs just under the threshold, which sketches let pass now and then, in blocks of a few sets: the search ends."""
    monkeypatch.setattr(jj, "SMALL_BLOCK", 8)
    rng = np.random.default_rng(4)
    base = " ".join(f"w{x}" for x in rng.integers(0, 3000, 200))
    data = list(enumerate([edited(rng, base, 2) for _ in range(70)]))
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(2)
    assert sorted(map(tuple, jj.similar_components(df).collect()), key=str) == brute(data)


def test_comparable_leaves_out_refused_pairs():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))] * 3
    x = jj.Sets(np.array([5, 1, 9]), np.array([5, 1, 9]), np.array([100] * 3), jj.sketches(sets), [[9], None, [5]])
    a, b, *labels = jj.comparable(x, x, True, jj.Bands(90), 4)
    assert sorted(zip(a, b)) == sorted(zip(*labels)) == [(1, 5), (1, 9)]
    a, b, *_ = jj.comparable(x.take(np.array([2])), x.take(np.array([0, 1])), False, jj.Bands(90), 4)
    assert sorted(zip(a, b)) == [(9, 1)]


def test_hot_group_meets_its_frequent_component_once(spark, monkeypatch):
    """Blocks of a group's most frequent component don't meet each other, and every other pair of sets meets."""
    monkeypatch.setattr(jj, "SMALL_BLOCK", 4)
    ids = list(range(40))
    label = lambda d: 0 if d < 34 else d
    members = spark.createDataFrame([(0, d, label(d)) for d in ids], "pivot bigint, doc_id bigint, label bigint")
    h = np.unique(np.random.default_rng(5).integers(0, 2**63, 50).astype(np.uint64))
    sets = spark.createDataFrame([(d, 50, bytearray(jj.sketches([h])[0])) for d in ids], "doc_id bigint, n_shingles bigint, sketch binary")
    groups = jj.open_groups(members)
    assert [tuple(r) for r in groups.collect()] == [(0, 0, 34, 6)]
    got = {(r.a, r.b): (r.label_a, r.label_b) for r in jj.proposals(members, groups, None, sets, jj.Bands(90), 100).collect()}
    assert got == {(a, b): (label(a), label(b)) for a in ids for b in ids if a < b and label(a) != label(b)}
