import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.llm import topk


def brute(rows, k):
    """Every row is a candidate, and a query if 50 divides its id; results of one query id are ranked together."""
    v = [(i, [int(np.floor(256 * float(c))) for c in x]) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x) and i is not None]
    pairs = {q: [] for q, _ in v if q % 50 == 0}
    for q, w in v:
        if q % 50 == 0:
            pairs[q] += [(-sum(a * b for a, b in zip(w, x)), i) for i, x in v if i != q and len(x) == len(w)]
    return sorted((q, r + 1, i, -s) for q, found in pairs.items() for r, (s, i) in enumerate(sorted(found)[:k]))


def result(df):
    return sorted(tuple(r)[:4] for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_brute(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) * np.geomspace(1, 0.05, 8)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[k][1]) for k in range(30)] + [(2000, None), (2050, []), (2100, [None] * 8), (2150, [float("nan")] * 8), (2200, [0.0] * 8), (2250, [1.0, 2.0]), (None, [1.0] * 8), (0, rows[0][1]), (50, rows[7][1]), (77, rows[7][1]), (77, rows[8][1]), (5000, [-1e6] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int").repartition(3)
    v = topk.quantised(df)
    for blocks in (8192, 37):
        got = topk.top_k(v, v.where("vec_id % 50 = 0"), 5, blocks, 7 if blocks == 37 else 2048)
        assert result(got) == brute(rows, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    v = topk.quantised(df)
    assert result(topk.top_k(v, v.where("vec_id % 50 = 0"), 5)) == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(v.where(F.lit(False)), v.where(F.lit(False)), 5).count() == 0


@pytest.mark.parametrize("large", [1e8, 1e30, -1e300])
def test_scores_that_leave_64_bits_raise(spark, large):
    df = spark.createDataFrame([(0, [large, 1.0]), (1, [large, 2.0])], "vec_id bigint, embedding array<double>")
    v = topk.quantised(df)
    with pytest.raises(OverflowError):
        topk.top_k(v, v.where("vec_id % 50 = 0"))


def test_large_scores_are_exact(spark):
    rows = [(0, [4e6, 3.0]), (1, [4e6, 2.0]), (2, [4e6, 2.00390625]), (3, [-4e6, 0.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert result(topk.top_k(v, v.where("vec_id % 50 = 0"))) == brute(rows, 5)


def test_it_stops_early():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(5000, 3))).astype(np.int64)
    lists = topk.Lists(np.arange(5000), v)
    ids, scores, scored = lists.search(v[7], 5, 7)
    assert scored < 2500
    want = sorted((-int(s), i) for i, s in enumerate(v @ v[7]) if i != 7)[:5]
    assert [(-int(s), int(i)) for s, i in zip(scores, ids)] == want
