"""Vectors against plain Python and NumPy models."""

import math
import operator

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavec.functions.types import VectorTypeError
from stratavec.operators import index
from stratavec.operators import vector as vec
from stratavec.operators.apply import apply
from stratavec.operators.index import SubscriptError, assign, from_values, subset
from stratavec.sources import binary, csv, generate

NAN, INF = math.nan, math.inf


def same(a, b):
    return len(a) == len(b) and all(x is y is None or (x is not None and y is not None and (x == y or (isinstance(x, float) and math.isnan(x) and math.isnan(y)))) for x, y in zip(a, b))


@pytest.mark.parametrize("op,a,b,want", [
    ("%%", [7, -7, 7, -7, 5, None], [3, 3, -3, -3, 0, 2], [1, 2, -2, -1, None, None]),
    ("%/%", [7, -7, 7, -7, 5, None], [3, 3, -3, -3, 0, 2], [2, -3, -3, 2, None, None]),
    ("%%", [5.5, -5.5, 5.0, 1.0, -1.0], [2.0, 2.0, 0.0, INF, INF], [1.5, 0.5, NAN, 1.0, INF]),
    ("/", [1, -1, 0, None], [0, 0, 0, 0], [INF, -INF, NAN, None]),
    ("^", [None, 1, 2], [0, None, 10], [1.0, 1.0, 1024.0]),
    ("+", [2**31 - 1, 1], [1, 1], [None, 2]),
    ("<", [1.0, NAN, None], [2.0, 2.0, 2.0], [True, None, None]),
    ("==", ["a", None, "b"], ["a", "a", "a"], [True, None, False]),
    ("<", ["a", "b"], ["b", "a"], [True, False]),
    ("|", [True, False, None, None], [None, None, True, False], [True, None, True, None]),
    ("&", [1.0, 0.0, NAN], [True, None, False], [True, False, False]),
    ("<", ["10", "9"], [9, 9], [True, False]),
])
def test_operators(spark, op, a, b, want):
    assert same(vec.binary(op, from_values(spark, a), from_values(spark, b)).collect(), want)


def test_types(spark):
    text, raw = from_values(spark, ["a"]), generate.constant(spark, "raw", 1)
    for op, x, y in (("+", text, 1), ("<", from_values(spark, [1j]), 1), ("==", raw, 1), ("%%", from_values(spark, [1j]), 2)):
        with pytest.raises(VectorTypeError):
            vec.binary(op, x, y)
    assert (from_values(spark, [True]) + from_values(spark, [True])).kind == "integer"
    assert (-from_values(spark, [True])).collect() == [-1]
    assert (~from_values(spark, [2, 0, None])).collect() == [False, True, None]


def test_complex(spark):
    a, b = [1 + 2j, 0j, None], [3 - 1j, 2 + 0j, 1j]
    for op, f in (("+", operator.add), ("*", operator.mul), ("/", operator.truediv), ("^", operator.pow)):
        got = vec.binary(op, from_values(spark, a), from_values(spark, b)).collect()
        for g, x, y in zip(got, a, b):
            assert (g is None) == (x is None) and (x is None or abs(complex(g["re"], g["im"]) - f(x, y)) < 1e-9)
    assert (from_values(spark, a) == from_values(spark, a)).collect() == [True, True, None]


def test_recycling_and_empty(spark):
    long, short = generate.sequence(spark, 1, 10), from_values(spark, [1, 2, 3])
    assert (long + short).collect() == [k + 1 + k % 3 + 1 for k in range(10)]
    assert (long + generate.constant(spark, "integer", 0)).collect() == []
    assert len(long + short) == 10


N = 100
SUBSCRIPTS = [None, [], [True], [False], [True, False], [True, None, False], [True] * (N + 3), 0, 1, [0, 1, 0, 42], [N + 1, 1], [1, None], [5, 5, 5], [-1], [-1, -1, 0, -500],
              [0.5, 1.1, 42.9], [-0.1, -42.9], [NAN, 3.0], list(range(N, 0, -1)), [-k for k in range(1, N)]]


def model(n, s):
    if s is None:
        return []
    s = s if isinstance(s, list) else [s]
    if any(isinstance(x, bool) for x in s):
        m = max(n, len(s))
        full = [s[k % len(s)] for k in range(m)]
        return [None if v is None or k >= n else k + 1 for k, v in enumerate(full) if v is None or v]
    bad = [x is None or x != x for x in s]
    if any(not b and x < 0 for b, x in zip(bad, s)):
        gone = {max(1, math.floor(-x)) for x in s if x < 0}
        return [k for k in range(1, n + 1) if k not in gone]
    return [None if b or x > n else math.floor(x) for b, x in zip(bad, s) if b or x >= 1]


@pytest.mark.parametrize("s", SUBSCRIPTS, ids=lambda s: str(s)[:30])
def test_subscripts(spark, s):
    x = generate.sequence(spark, 1, N)
    rows, n = index.subscript(x, s)
    assert [r["pos"] for r in rows.orderBy("k").collect()] == model(N, s) and n == len(model(N, s))
    assert subset(x, s).collect() == model(N, s)


def test_subscript_errors(spark):
    x = generate.sequence(spark, 1, 5)
    for s in ([-1, 1], [-1, None], [1j]):
        with pytest.raises(SubscriptError):
            subset(x, s).collect()


def test_names(spark):
    x = from_values(spark, [10, 20, 30, 40]).named_by(from_values(spark, ["a", "", "a", "b"]))
    assert subset(x, ["b", "a", "", None, "z"]).collect() == [40, 10, None, None, None]
    assert subset(from_values(spark, [1]), ["a"]).collect() == [None]


def test_assign(spark):
    x = generate.sequence(spark, 1, 10)
    assert assign(x, [2, 3, 2, None, 99], [7.9, 8, 9, 1, 1]).collect() == [1, 9, 8, *range(4, 11)]
    assert assign(x, [True, False], [None]).collect() == [None if k % 2 else k for k in range(1, 11)]
    with pytest.raises(ValueError):
        assign(x, [1, 2, 3], [1, 2])


def test_slices_and_matrix(spark):
    x = generate.sequence(spark, 1, 256).reshape(16, 16)
    assert x[3, 2].collect() == [19] and x[5:9].collect() == [5, 6, 7, 8, 9] and x[2:9:3].collect() == [2, 5, 8]
    assert {(r["i"], r["j"], r["value"]) for r in x.cells().collect()} == {(k % 16 + 1, k // 16 + 1, k + 1) for k in range(256)}


@pytest.mark.parametrize("kind,values", [("integer", [1, None, -5]), ("numeric", [1.5, None, NAN, -INF]), ("logical", [True, None, False]), ("complex", [1 + 2j, None])])
def test_binary(spark, tmp_path, kind, values):
    path = f"{tmp_path}/v.bin"
    assert binary.store(path, from_values(spark, values, kind)) == len(values)
    got = [complex(v["re"], v["im"]) if isinstance(v, tuple) else v for v in binary.read(spark, path, kind, 2).collect()]
    assert same(got, values)


def test_binary_layout(spark, tmp_path):
    path = f"{tmp_path}/v.bin"
    np.arange(100_000, dtype="<i4").tofile(path)
    v = binary.read(spark, path, "integer", 30_000)
    assert v.length == 100_000 and v.sum().first()[0] == 100_000 * 99_999 // 2
    assert v[50_001:50_003].collect() == [50_000, 50_001, 50_002]
    assert v.frame.where("idx = 7").collect()[0]["value"] == 6
    open(path, "ab").write(b"x")
    with pytest.raises(ValueError):
        binary.read(spark, path, "integer")
    empty = f"{tmp_path}/e.bin"
    assert binary.store(empty, generate.constant(spark, "raw", 0)) == 0 and binary.read(spark, empty, "raw").collect() == []


FIXTURE = 'a0, b0, , d0\n  a1 ,"b1", c1\na2,,b2,"  d2  "\n"a3""",b3,"""",\n"a\\"4","b\\\\4", c4, d4'


def test_csv_exact(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    open(path, "w").write(FIXTURE)
    t = csv.read(spark, path)
    assert t.names == ["a0", "b0", "X", "d0"] and set(t.kinds.values()) == {"character"}
    assert [tuple(r)[1:] for r in t.to_df().orderBy("idx").collect()] == [("a1", "b1", "c1", ""), ("a2", "", "b2", "  d2  "), ('a3"', "b3", '"', ""), ('a\\"4', "b\\4", "c4", "d4")]


@pytest.mark.parametrize("cells,kind,values", [
    (["NA", "NA"], "logical", [None, None]), (["", ""], "logical", [None, None]), (["T", "F", "NA"], "logical", [True, False, None]), (["1", "NA"], "integer", [1, None]),
    (["1", "2.5"], "numeric", [1.0, 2.5]), (["1", "T"], "integer", [1, None]), (["2147483648"], "numeric", [2147483648.0]), (["1", "x"], "character", ["1", "x"]), (["x", "NA", ""], "character", ["x", None, ""]),
])
def test_csv_inference(spark, tmp_path, cells, kind, values):
    path = f"{tmp_path}/t.csv"
    open(path, "w").write("k,v\n" + "".join(f"{k},{c}\n" for k, c in enumerate(cells)))
    t = csv.read(spark, path)
    assert t.kinds["v"] == kind and t["v"].collect() == values


def test_csv_shapes(spark, tmp_path):
    assert list(csv.parse("a\n\nb,c\n")) == [["a"], [""], ["b", "c"]]
    assert list(csv.parse("")) == [] and list(csv.parse("a,")) == [["a", ""]] and list(csv.parse('"a\nb"\r\nc')) == [["a\nb"], ["c"]]
    for bad in ('"a', '"a"b'):
        with pytest.raises(csv.CsvError):
            list(csv.parse(bad))
    path = f"{tmp_path}/h.csv"
    open(path, "w").write("a,b")
    t = csv.read(spark, path)
    assert t.names == ["a", "b"] and len(t) == 0 and t.kinds == {"a": "logical", "b": "logical"}
    open(path, "w").write("1\n2,3\n")
    assert [tuple(r) for r in csv.read(spark, path, header=False).to_df().orderBy("idx").collect()] == [(1, 1, None), (2, 2, 3)]
    assert csv.make_names(["a b", "1", "", "a b", "ok", "_x"]) == ["a.b", "X1", "X", "a.b.1", "ok", "X_x"]


def test_csv_files_are_split(spark, tmp_path):
    """Rows of all kinds over many small parts, quoted cells across several of them: as parsed in one piece."""
    rng = np.random.default_rng(0)
    pieces = ['"a,b"', '"x\ny"', '"""', 'plain', ' pad ', '"\\"\n\\\\"', 'a"b', '""', '', '"q""q\n\n"', '  "lead"  ', '"' + "long\n" * 60 + '"']
    cells = [p if p != '"""' else '""""' for p in pieces]
    for trial in range(2):
        text = "h1,h2,h3\n" + "".join(",".join(rng.choice(cells, int(rng.integers(1, 4)))) + "\n" for _ in range(60))
        text = text[:-1] if trial % 2 else text
        path = f"{tmp_path}/s{trial}.csv"
        open(path, "w", newline="").write(text)
        whole = list(csv.parse(text))
        width = max(map(len, whole))
        want = [[*r, *[""] * (width - len(r))] for r in whole[1:]]
        before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        try:
            for size, batch in (("64", "3"), ("300", "10000"), ("1000000", "2")):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "1")
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
                t = csv.read(spark, path)
                got = [list(r)[1:] for r in t.to_df().orderBy("idx").collect()]
                assert [[x or "" for x in r] for r in got] == want and len(got) == len(t)
                one = csv.read(spark, path, columns=["h3", "h1"])
                assert one.names == ["h3", "h1"] and [[x or "" for x in r][1:] for r in one.to_df().orderBy("idx").collect()] == [[r[2], r[0]] for r in want]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])


def test_csv_refuses_what_it_cannot_order_or_end(spark, tmp_path):
    for k in (1, 2):
        open(f"{tmp_path}/{k}.csv", "w").write("a\n1\n")
    open(f"{tmp_path}/1.csv", "a").write('"open\n')
    for path, dialect in ((str(tmp_path), "exact"), (str(tmp_path), "standard"), (f"{tmp_path}/1.csv", "exact")):
        with pytest.raises(csv.CsvError):
            csv.read(spark, path, dialect=dialect)
    with pytest.raises(csv.CsvError):
        csv.read(spark, f"{tmp_path}/2.csv", columns=["b"])


def test_extract(spark):
    x = generate.sequence(spark, 1, 60).reshape(3, 4, 5)
    a = np.arange(1, 61).reshape((3, 4, 5), order="F")
    for at, own in (((slice(None), 2, [5, 1, 5]), ([0, 1, 2], [1], [4, 0, 4])), ((3, slice(2, 4, 2), None), ([2], [1, 3], range(5))), (([2], [1, 1], slice(5, 5)), ([1], [0, 0], [4])), (([], 1, 1), ([], [0], [0]))):
        got, want = index.extract(x, *at), a[np.ix_(*map(list, map(np.array, own)))] if all(len(o) for o in own) else np.zeros((0, 1, 1))
        assert got.dim == want.shape and got.collect() == want.ravel(order="F").tolist()
    assert x[3, 4, 5].collect() == [60] and x[:, 1, 1].collect() == [1, 2, 3]
    for bad in ((0, 1, 1), (1, 5, 1), (1, 1), (slice(0, 2), 1, [6])):
        with pytest.raises(SubscriptError):
            index.extract(x, *bad)


@pytest.mark.parametrize("s", SUBSCRIPTS, ids=lambda s: str(s)[:30])
def test_subscript_lengths(spark, s):
    assert index.subscript_length(generate.sequence(spark, 1, N), s) == len(model(N, s))


def test_members(spark):
    x = from_values(spark, ["a", None, "b", "a"])
    assert x.is_in(from_values(spark, ["a", "z"])).collect() == [True, False, False, True]
    assert x.is_in(from_values(spark, [None], "character")).collect() == [False, True, False, False]
    assert from_values(spark, [1, 2, None]).is_in(from_values(spark, ["2"])).collect() == [False, True, False]
    assert index.count_members(from_values(spark, [1, 2, 2, 3]), from_values(spark, [2.0, 9.0])).first()[0] == 2
    assert x.is_in(generate.constant(spark, "character", 0)).collect() == [False] * 4


@pytest.mark.parametrize("size", [1, 3, 100])
def test_apply_chunks_and_names(spark, size):
    x = generate.sequence(spark, 1, 10).named_by(from_values(spark, list("abcdefghij")))
    out = apply(lambda s: s.cumsum(), x, chunk_size=size)
    assert out.kind == "integer" and out.collect() == [sum(range((k - 1) // size * size + 1, k + 1)) for k in range(1, 11)]
    assert subset(out, ["c"]).collect() == out.collect()[2:3]
    assert apply(lambda s: s, x, use_names=False).names is None and apply(lambda s: s, x, use_names=False, chunk_size=size).names is None
    words = apply(lambda s: s.str.upper(), from_values(spark, ["p", "q"]), chunk_size=size)
    assert words.kind == "character" and subset(words, ["q"]).collect() == ["Q"]
    first_missing = from_values(spark, [None, 1, 2], "integer")
    assert apply(lambda s: s.map(lambda v: None if v != v else f"v{v:.0f}"), first_missing).collect() == [None, "v1", "v2"]
    with pytest.raises(ValueError):
        apply(lambda s: s, x, chunk_size=0)


def test_casts(spark):
    def cast(values, to, kind=None):
        return from_values(spark, values, kind).cast(to).collect()

    assert cast([3.7, -3.7, NAN, 3e9], "integer") == [3, -3, None, None]
    assert cast(["3.7", " 4 ", "0x10", "-0xF", "x", "NA", "1e3"], "integer") == [3, 4, 16, -15, None, None, 1000]
    assert cast(["T", "true", "yes", "F", None], "logical") == [True, True, None, False, None]
    assert cast([1.0, 1.5, 1e15, 0.1, NAN, INF, 123456.0, 100000.0, 1e-5], "character") == ["1", "1.5", "1e+15", "0.1", "NaN", "Inf", "123456", "1e+05", "1e-05"]
    assert [tuple(z) for z in cast(["1+2i", "-1.5-0.5i", "3", "2i"], "complex")] == [(1, 2), (-1.5, -0.5), (3, 0), (0, 2)]
    with pytest.raises(VectorTypeError):
        from_values(spark, [1]).cast("raw")


def test_apply_and_sources(spark):
    a, b, c = (generate.sequence(spark, 1, n) for n in (10_000, 1000, 100))
    got = apply(lambda x, y, z: x + y * z, a, b, c)
    assert got.kind in ("integer", "numeric") and got.collect() == [k + 1 + (k % 1000 + 1) * (k % 100 + 1) for k in range(10_000)]
    assert generate.generated(spark, lambda s, e: list(range(s, e)), 1000, "numeric", 64).sum().first()[0] == 499_500
    assert generate.sequence(spark, 5, -5, -2).collect() == [5, 3, 1, -1, -3, -5]
    with pytest.raises(ValueError):
        generate.sequence(spark, 5, 1, strict=True)
    assert generate.constant(spark, "complex", 2, True).collect() == [None, None]
    assert generate.sequence(spark, 1, 1000).sum().first()[0] == 500_500 and list(generate.sequence(spark, 1, 4)) == [1, 2, 3, 4]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=12), st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=12))
def test_integer_arithmetic(spark, a, b):
    n = max(len(a), len(b))
    pairs = [(a[k % len(a)], b[k % len(b)]) for k in range(n)]
    x, y = from_values(spark, a, "integer"), from_values(spark, b, "integer")
    want = [None if p is None or q in (None, 0) else p % q for p, q in pairs]
    assert (x % y).collect() == want
    assert (x // y).collect() == [None if p is None or q in (None, 0) else p // q for p, q in pairs]


def test_stream(spark, tmp_path):
    from stratavec.streaming import map_stream

    spark.range(10).selectExpr("id", "cast(id as int) v").write.parquet(f"{tmp_path}/in")
    s = map_stream(spark.readStream.schema("id long, v int").parquet(f"{tmp_path}/in"), "v", "%%", -3)
    q = s.writeStream.format("memory").queryName("mapped").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["v"] for r in spark.table("mapped").collect()) == sorted(-(-k % 3) for k in range(10))


def test_complex_texts_have_plain_whole_parts(spark):
    z = from_values(spark, [100000 - 2j, 900000 + 1.5j, -200000 + 1e15j, 1e5 - 1e-5j, 0.1 + 0j, None], "complex")
    texts = z.cast("character")
    assert texts.collect() == ["100000-2i", "900000+1.5i", "-200000+1e+15i", "100000-1e-05i", "0.1+0i", None]
    assert [t and tuple(t) for t in texts.cast("complex").collect()] == [(100000, -2), (900000, 1.5), (-200000, 1e15), (100000, -1e-5), (0.1, 0), None]


def test_fold_loops_in_order_on_executors(spark):
    x = generate.sequence(spark, 1, 5000)
    shuffled = vec.Vector(x.frame.repartition(7), x.value, "integer")
    pairs = shuffled.fold([], lambda s, k, v: [*s[-3:], (k, v)], lambda a, b: a + b)
    assert pairs[-1] == (5000, 5000) and pairs == sorted(pairs)
    assert shuffled.fold((), lambda s, k, v: (*s, v), lambda a, b: a + b) == tuple(range(1, 5001))
    assert generate.constant(spark, "numeric", 0).fold(0, lambda s, k, v: s + 1, operator.add) == 0


def test_element_loop_sends_states_only(spark, monkeypatch):
    from stratavec.plans import catalog

    def refuse(self):
        raise AssertionError("the driver asks for every element")

    monkeypatch.setattr(vec.Vector, "__iter__", refuse)
    assert catalog.element_loop(spark, "/root/testdata/sf0.001").first()["n"] == 1500
