import itertools
import time

import numpy as np

from stratavec.llm import decontamination as dc

RNG = np.random.default_rng(5)
VOCAB = [f"w{k}" for k in range(4000)]
ITEMS = [(k, " ".join(RNG.choice(VOCAB, n))) for k, n in enumerate((40, 25, 14, 9, 8, 5, 200, 0))]


def brute(doc, item):
    """Longest stretch of agreement over all diagonals."""
    d, t = dc.words(doc), dc.words(item)
    best = 0
    for diagonal in range(-len(t) + 1, len(d)):
        equal = [d[p + diagonal] == t[p] for p in range(len(t)) if 0 <= p + diagonal < len(d)]
        for a, b in itertools.combinations(range(len(equal) + 1), 2):
            if equal[a] and equal[b - 1] and sum(equal[a:b]) * 10 >= 8 * (b - a):
                best = max(best, b - a)
    return best if len(t) >= dc.MIN_ITEM and best >= (dc.MIN_WORDS if len(t) >= dc.MIN_WORDS else len(t)) else 0


def damaged(text, share):
    w = text.split()
    for k in RNG.choice(len(w), int(len(w) * share), replace=False):
        w[k] = "other"
    return " ".join(w)


def docs():
    noise = lambda n: " ".join(RNG.choice(VOCAB, n))
    out = [(100, noise(300)), (101, f"{noise(30)} {ITEMS[0][1].upper()}, {noise(20)}"), (102, damaged(ITEMS[0][1], 0.15)), (103, f"{noise(9)}\n{damaged(ITEMS[6][1], 0.18)}"), (104, ITEMS[0][1][: len(ITEMS[0][1]) // 3]),
           (105, ITEMS[2][1]), (106, ITEMS[3][1].replace(" ", " - ")), (107, ITEMS[4][1]), (108, ITEMS[5][1]), (109, None), (110, ""), (111, ITEMS[1][1] + " " + ITEMS[1][1]), (111, ITEMS[1][1]), (None, ITEMS[1][1]), (112, damaged(ITEMS[0][1], 0.6))]
    return out


def test_masks_find_every_overlap():
    for region, most in ((20, 4), (14, 2)):
        placed = [sum(1 << (s + k) for k, c in enumerate(m) if c == "1") for m in dc.MASKS for s in range(region - len(m) + 1)]
        for wrong in itertools.combinations(range(region), most):
            bits = sum(1 << p for p in wrong)
            assert any(not p & bits for p in placed)


def test_masks_find_every_short_item():
    for n in range(dc.MIN_ITEM, dc.MIN_WORDS + 1):
        masks = [m for m in (*dc.MASKS, *(dc.SHORT_MASKS if n <= dc.SHORT else ())) if len(m) <= n]
        placed = [sum(1 << (s + k) for k, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1)]
        for wrong in itertools.combinations(range(n), n // 5):
            bits = sum(1 << p for p in wrong)
            assert any(not p & bits for p in placed), (n, wrong)


def test_short_items_with_substitutions():
    """Every placement of as many differing words as AGREEMENT allows (a few of one more), in the middle of noise."""
    for n in (8, 9, 10, 11, 12, 15, 18, 20):
        item = [f"i{k}" for k in range(n)]
        index = dc.build([(7, " ".join(item))])
        most = n // 5
        placements = list(itertools.combinations(range(n), most))
        if len(placements) > 500:
            placements = [placements[k] for k in RNG.choice(len(placements), 497, replace=False)] + [(0, *range(n - most + 1, n)), (*range(most - 1), n - 1), tuple(range(most))]
        more = list(itertools.combinations(range(n), most + 1))[:50]
        docs = [["a", "b", *("x" if k in wrong else w for k, w in enumerate(item)), "c"] for wrong in (*placements, *more)]
        hashed = dc.WordHashes()
        got = dc.matches(index, [hashed.of(" ".join(d).encode().split()) for d in docs])
        assert got == [(k, 0, 2, 0, n, n - most) for k in range(len(placements))]


def test_brute(spark):
    rows = docs()
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, item_id string").repartition(3)
    b = spark.createDataFrame([*ITEMS, (None, "a b c d e f g h i j"), (50, None)], "item_id bigint, text string")
    want = sorted(((i, k, n) for i, t in rows for k, item in ITEMS if (n := brute(t or "", item))), key=str)
    for words in (dc.BLOCK_WORDS, 60):
        got = sorted(((r.doc_id, r.item_id, r.n_words) for r in dc.overlaps(d, b, words).collect()), key=str)
        assert got == want
        clean = dc.decontaminate(d, b, words)
        assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in rows if not any(brute(t or "", x) for _, x in ITEMS))
    assert {i for i, _, _ in want} >= {101, 102, 103, 105, 106, 107, 111, None} and not {100, 104, 108, 112} & {i for i, _, _ in want}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame(docs(), "doc_id bigint, text string")
    assert dc.overlaps(none, items).count() == dc.overlaps(some, items).count() == 0
    assert dc.decontaminate(some, items).count() == len(docs())


def test_repeated_words_are_exact_and_fast(monkeypatch):
    """Texts of few different words, where windows repeat, against all diagonals; and long ones in little time."""
    rng = np.random.default_rng(8)
    hashed = dc.WordHashes()
    of = lambda t: hashed.of(t.encode().split())
    for joined in (1 << 21, 7):
        monkeypatch.setattr(dc, "JOINED", joined)
        for _ in range(40):
            runs = lambda n: " ".join(w for k in range(n) for w in [f"r{rng.integers(2)}"] * int(rng.integers(1, 16)))
            items, texts = [runs(int(rng.integers(1, 6))) for _ in range(3)], [runs(int(rng.integers(1, 12))) for _ in range(3)]
            index = dc.build(list(enumerate(items)))
            got = {(d, int(index.ids[i])): n for d, i, _, _, n, _ in dc.matches(index, [of(t) for t in texts])}
            want = {(d, i): n for d, t in enumerate(texts) for i, item in enumerate(items) if len(item.split()) > dc.MIN_WORDS and (n := brute(t, item))}
            assert {k: n for k, n in got.items() if len(items[k[1]].split()) > dc.MIN_WORDS} == want
    monkeypatch.undo()
    index = dc.build([(1, "same " * 200), (2, "same " * 30 + "other " * 30)])
    began = time.perf_counter()
    found = dc.matches(index, [of("same " * 100_000), of("same other " * 50_000)])
    assert [(d, i, n) for d, i, _, _, n, _ in found] == [(0, 0, 200), (0, 1, 30)] and time.perf_counter() - began < 60


def test_masks_find_every_length():
    """Overlaps of 20 words with 4 differing are hit; so is every longer one, which holds such a stretch or fewer differing words."""
    for n in (21, 22, 23, 24, 25):
        placed = [sum(1 << (s + k) for k, c in enumerate(m) if c == "1") for m in dc.MASKS for s in range(n - len(m) + 1)]
        for wrong in itertools.combinations(range(1, n - 1), n // 5):
            bits = sum(1 << p for p in wrong)
            assert any(not p & bits for p in placed), (n, wrong)


def test_longest_agreement():
    for _ in range(200):
        e = RNG.random(RNG.integers(0, 25)) < 0.7
        a, b = dc.longest_agreement(e)
        want = max((y - x for x, y in itertools.combinations(range(len(e) + 1), 2) if e[x] and e[y - 1] and e[x:y].sum() * 10 >= 8 * (y - x)), default=0)
        assert b - a == want
