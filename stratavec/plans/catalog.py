"""One query for each operator, over whole sample tables, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.operators import index
from stratavec.operators import vector as vec
from stratavec.operators.apply import apply, chunk, chunk_bounds
from stratavec.operators.vector import Vector
from stratavec.plans.session import scratch, table, vector
from stratavec.sources import binary, csv, generate

QUERIES, SQL = {}, {}

# Vectors over the tables; the same expressions in SQL.
_ORDERS = "(SELECT o_orderkey + 1 AS idx, o_totalprice AS price, CAST(o_orderkey % 1000 - 500 AS INTEGER) AS i, CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 11 - 5 END AS INTEGER) AS j, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS f, o_orderkey % 3 = 0 AS g, o_orderpriority AS s FROM orders)"


def _orders(spark, d, what, kind=None) -> Vector:
    o = F.col("o_orderkey")
    value = {
        "price": "o_totalprice", "i": (o % 1000 - 500).cast("int"), "j": F.when(o % 7 != 0, F.col("o_custkey") % 11 - 5).cast("int"),
        "f": F.when(o % 5 != 0, F.col("o_orderstatus") == "F"), "g": o % 3 == 0, "s": "o_orderpriority",
    }[what]
    return vector(spark, d, "orders", value, "o_orderkey", kind)


def _pair(spark, d, *what) -> list[Vector]:
    """Vectors of one frame."""
    first = _orders(spark, d, what[0])
    return [first, *(Vector(first.frame, _orders(spark, d, w).value, _orders(spark, d, w).kind) for w in what[1:])]


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _elementwise(name: str, op: str, a: str, b, expression: str, kind: str):
    """``a op b`` over orders, b a column or a scalar."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        x, *y = _pair(spark, d, a, *([b] if isinstance(b, str) and len(b) <= 5 else []))
        return vec.binary(op, x, y[0] if y else b).to_df()

    query(name, f"SELECT idx, CAST({expression} AS {kind}) AS value FROM {_ORDERS}")(run)


_MOD = "CASE WHEN {b} <> 0 THEN {a} - CAST(floor(CAST({a} AS DOUBLE) / {b}) AS BIGINT) * {b} END"
_IDIV = "CASE WHEN {b} <> 0 THEN floor(CAST({a} AS DOUBLE) / {b}) END"
_DIV = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN CAST('NaN' AS DOUBLE) WHEN {a} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END ELSE CAST({a} AS DOUBLE) / {b} END"
_elementwise("vec_add", "+", "i", "j", "i + j", "INTEGER")
_elementwise("vec_sub", "-", "price", "j", "price - j", "DOUBLE")
_elementwise("vec_mul", "*", "i", "j", "i * j", "INTEGER")
_elementwise("vec_div", "/", "price", 4, "price / 4", "DOUBLE")
_elementwise("vec_div_by_zero", "/", "i", "j", _DIV.format(a="i", b="j"), "DOUBLE")
_elementwise("vec_intdiv", "%/%", "i", "j", _IDIV.format(a="i", b="j"), "INTEGER")
_elementwise("vec_mod_negative", "%%", "i", -3, _MOD.format(a="i", b="(-3)"), "INTEGER")
_elementwise("vec_mod", "%%", "i", "j", _MOD.format(a="i", b="j"), "INTEGER")
_elementwise("vec_pow", "^", "i", 2, "CASE WHEN i = 1 THEN 1.0 ELSE power(i, 2) END", "DOUBLE")
_elementwise("vec_pow_na", "^", "j", 0, "1.0", "DOUBLE")
for _n, _op, _sql in (("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">="), ("eq", "==", "="), ("ne", "!=", "<>")):
    _elementwise(f"vec_{_n}", _op, "i", "j", f"i {_sql} j", "BOOLEAN")
_elementwise("vec_lt_text", "<", "s", "3-MEDIUM", "s < '3-MEDIUM'", "BOOLEAN")
_elementwise("vec_or_null", "|", "f", "g", "f OR g", "BOOLEAN")
_elementwise("vec_and_null", "&", "f", "g", "f AND g", "BOOLEAN")
_elementwise("vec_or_number", "|", "j", "g", "(j <> 0) OR g", "BOOLEAN")


@query("vec_neg", f"SELECT idx, -i AS value FROM {_ORDERS}")
def vec_neg(spark, d):
    return (-_orders(spark, d, "i")).to_df()


@query("vec_pos", f"SELECT idx, price AS value FROM {_ORDERS}")
def vec_pos(spark, d):
    return (+_orders(spark, d, "price")).to_df()


@query("vec_not", f"SELECT idx, NOT f AS value FROM {_ORDERS}")
def vec_not(spark, d):
    return (~_orders(spark, d, "f")).to_df()


@query("vec_overflow", f"SELECT idx, CAST(CASE WHEN abs(CAST(i AS BIGINT) * 10000000) <= 2147483647 THEN CAST(i AS BIGINT) * 10000000 END AS INTEGER) AS value FROM {_ORDERS}")
def vec_overflow(spark, d):
    return (_orders(spark, d, "i") * 10_000_000).to_df()


@query("vec_recycle", f"SELECT o.idx, o.i + CAST(o_size AS INTEGER) AS value FROM {_ORDERS} o JOIN (SELECT p_partkey AS k, p_size AS o_size FROM part) p ON p.k = (o.idx - 1) % (SELECT count(*) FROM part)")
def vec_recycle(spark, d):
    return (_orders(spark, d, "i") + vector(spark, d, "part", "p_size", "p_partkey")).to_df()


@query("vec_align_join", "SELECT e.event_id + 1 AS idx, e.value * d.n_chars AS value FROM (SELECT event_id, value FROM events) e JOIN (SELECT doc_id, n_chars FROM documents) d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)")
def vec_align_join(spark, d):
    return (vector(spark, d, "events", "value", "event_id") * vector(spark, d, "documents", "n_chars", "doc_id")).to_df()


@query("vec_complex", f"SELECT idx, CAST(i * 2 - 3 * j AS DOUBLE) AS re, CAST(3 * i + 2 * j AS DOUBLE) AS im FROM {_ORDERS} WHERE j IS NOT NULL")
def vec_complex(spark, d):
    i, j = _pair(spark, d, "i", "j")
    z = i + j * 1j
    out = (z * (2 + 3j)).to_df().where("value is not null")
    return out.select("idx", (F.col("value.re") + 0.0).alias("re"), (F.col("value.im") + 0.0).alias("im"))


# -- subscripts: (k, pos) ---------------------------------------------------------------------------
def _positions(pair):
    return pair[0].select("k", "pos")


def _sub(name: str, sql: str, subscript, what: str = "price"):
    def run(spark, d):
        s = subscript(spark, d) if callable(subscript) else subscript
        return _positions(index.subscript(_orders(spark, d, what), s))

    query(name, sql)(run)


_N = "(SELECT count(*) FROM orders)"
_EVENT_POS = "SELECT event_id + 1 AS k, {pos} AS pos FROM events"
_sub("sub_null", "SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderkey AS BIGINT) AS pos FROM orders WHERE 1 = 0", None)
_sub("sub_lgl_recycle", f"SELECT row_number() OVER (ORDER BY idx) AS k, idx AS pos FROM {_ORDERS} WHERE (idx - 1) % 3 <> 1", [True, False, True])
_sub("sub_lgl_na", f"SELECT row_number() OVER (ORDER BY idx) AS k, CASE WHEN (idx - 1) % 3 = 0 THEN idx END AS pos FROM {_ORDERS} WHERE (idx - 1) % 3 <> 1", [True, False, None])
_sub("sub_pos", f"SELECT row_number() OVER (ORDER BY k) AS k, CASE WHEN s <= {_N} THEN s END AS pos FROM (SELECT event_id AS k, event_id * 7 % 20011 AS s FROM events) WHERE s <> 0",
     lambda spark, d: vector(spark, d, "events", (F.col("event_id") * 7 % 20011).cast("int"), "event_id"))
_sub("sub_neg", f"SELECT row_number() OVER (ORDER BY idx) AS k, idx AS pos FROM {_ORDERS} WHERE idx NOT IN (SELECT user_id % 500 FROM events)",
     lambda spark, d: vector(spark, d, "events", (-(F.col("user_id") % 500)).cast("int"), "event_id"))
_sub("sub_real_trunc", f"SELECT row_number() OVER (ORDER BY k) AS k, CASE WHEN s <= {_N} THEN CAST(floor(s) AS BIGINT) END AS pos FROM (SELECT event_id AS k, event_id * 0.75 AS s FROM events) WHERE s >= 1",
     lambda spark, d: vector(spark, d, "events", (F.col("event_id") * F.lit(0.75)), "event_id"))
_sub("sub_real_neg", f"SELECT row_number() OVER (ORDER BY idx) AS k, idx AS pos FROM {_ORDERS} WHERE idx NOT IN (1, 10, 42)", [-0.1, -1.1, -10.5, -42.9])
_sub("sub_oob", f"SELECT 1 AS k, 1 AS pos UNION ALL SELECT 2, NULL UNION ALL SELECT 3, NULL UNION ALL SELECT 4, {_N}", lambda spark, d: [1, 2_000_000_000, None, table(spark, d, "orders").count()])


@query("sub_name_lookup", "SELECT event_id + 1 AS k, (SELECT min(c_custkey) + 1 FROM customer WHERE c_mktsegment = CASE WHEN event_type = 'click' THEN 'BUILDING' WHEN event_type = 'view' THEN 'NOWHERE' ELSE 'MACHINERY' END) AS pos FROM events")
def sub_name_lookup(spark, d):
    x = vector(spark, d, "customer", "c_acctbal", "c_custkey").set_names("c_mktsegment")
    kind = F.col("event_type")
    s = vector(spark, d, "events", F.when(kind == "click", "BUILDING").when(kind == "view", "NOWHERE").otherwise("MACHINERY"), "event_id")
    return _positions(index.subscript(x, s))


# -- subset and assignment --------------------------------------------------------------------------
@query("subset_range", f"SELECT idx - 99 AS idx, price AS value FROM {_ORDERS} WHERE idx BETWEEN 100 AND 1099")
def subset_range(spark, d):
    return _orders(spark, d, "price")[100:1099].to_df()


@query("subset_stride", f"SELECT idx // 2 AS idx, price AS value FROM {_ORDERS} WHERE idx % 2 = 0")
def subset_stride(spark, d):
    return _orders(spark, d, "price")[2::2].to_df()


@query("subset_dups", f"SELECT e.event_id + 1 AS idx, price AS value FROM events e LEFT JOIN {_ORDERS} o ON o.idx = e.user_id % 50 + 1")
def subset_dups(spark, d):
    return _orders(spark, d, "price")[vector(spark, d, "events", (F.col("user_id") % 50 + 1).cast("int"), "event_id")].to_df()


@query("subset_anti", f"SELECT row_number() OVER (ORDER BY idx) AS idx, price AS value FROM {_ORDERS} WHERE idx NOT IN (SELECT user_id + 1 FROM events)")
def subset_anti(spark, d):
    return _orders(spark, d, "price")[vector(spark, d, "events", (-F.col("user_id") - 1).cast("int"), "event_id")].to_df()


@query("subset_mask", f"SELECT row_number() OVER (ORDER BY idx) AS idx, CASE WHEN f THEN price END AS value FROM {_ORDERS} WHERE f IS NULL OR f")
def subset_mask(spark, d):
    x, f = _pair(spark, d, "price", "f")
    return x[f].to_df()


@query("subset_raw_na", f"SELECT idx, CASE WHEN idx % 2 = 0 THEN 0 ELSE idx % 256 END AS value FROM {_ORDERS}")
def subset_raw_na(spark, d):
    x = vector(spark, d, "orders", ((F.col("o_orderkey") + 1) % 256).cast("smallint"), "o_orderkey", "raw")
    at = vector(spark, d, "orders", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1).cast("int"), "o_orderkey")
    return x[at].to_df().withColumn("value", F.col("value").cast("int"))


@query("assign_range", f"SELECT idx, CASE WHEN idx BETWEEN 11 AND 510 THEN -1.5 ELSE price END AS value FROM {_ORDERS}")
def assign_range(spark, d):
    return index.assign(_orders(spark, d, "price"), slice(11, 510), -1.5).to_df()


@query("assign_recycle", f"SELECT idx, CASE WHEN idx <= 300 THEN CASE (idx - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE 9 END ELSE i END AS value FROM {_ORDERS}")
def assign_recycle(spark, d):
    return index.assign(_orders(spark, d, "i"), slice(1, 300), [7, None, 9]).to_df()


@query("assign_last_wins", f"SELECT o.idx, CASE WHEN e.k IS NULL THEN i ELSE CAST(e.k AS INTEGER) END AS value FROM {_ORDERS} o LEFT JOIN (SELECT user_id + 1 AS pos, max(event_id) + 1 AS k FROM events GROUP BY user_id) e ON e.pos = o.idx")
def assign_last_wins(spark, d):
    at = vector(spark, d, "events", (F.col("user_id") + 1).cast("int"), "event_id")
    new = vector(spark, d, "events", (F.col("event_id") + 1).cast("int"), "event_id")
    return index.assign(_orders(spark, d, "i"), at, new).to_df()


# -- sources ----------------------------------------------------------------------------------------
@query("seq_int", "SELECT CAST(r AS BIGINT) AS idx, CAST(3 + (r - 1) * 4 AS INTEGER) AS value FROM range(1, 25001) t(r)")
def seq_int(spark, d):
    return generate.sequence(spark, 3, 100_000, 4).to_df()


@query("seq_neg_by", "SELECT CAST(r AS BIGINT) AS idx, CAST(100 - (r - 1) * 7 AS DOUBLE) AS value FROM range(1, 30) t(r)")
def seq_neg_by(spark, d):
    return generate.sequence(spark, 100, -99, -7, "numeric").to_df()


@query("seq_sum", "SELECT CAST(512000016000000 AS BIGINT) AS sum")
def seq_sum(spark, d):
    return generate.sequence(spark, 1, 32_000_000).sum()


@query("const_na", "SELECT CAST(r AS BIGINT) AS idx, CAST(NULL AS INTEGER) AS value FROM range(1, 1001) t(r)")
def const_na(spark, d):
    return generate.constant(spark, "integer", 1000, True).to_df()


@query("const_default", "SELECT CAST(r AS BIGINT) AS idx, '' AS value FROM range(1, 1001) t(r)")
def const_default(spark, d):
    return generate.constant(spark, "character", 1000).to_df()


def _round_trip(what, kind):
    def run(spark, d):
        v = _orders(spark, d, what, kind)
        binary.store(path := f"{scratch(spark, 'bin')}/v.bin", v)
        return binary.read(spark, path, kind).to_df()

    return run


query("bin_roundtrip_int", f"SELECT idx, j AS value FROM {_ORDERS}")(_round_trip("j", "integer"))
query("bin_roundtrip_dbl", f"SELECT idx, price AS value FROM {_ORDERS}")(_round_trip("price", "numeric"))
query("bin_roundtrip_lgl", f"SELECT idx, f AS value FROM {_ORDERS}")(_round_trip("f", "logical"))


@query("bin_roundtrip_raw", "SELECT o_orderkey + 1 AS idx, CAST(o_custkey % 256 AS INTEGER) AS value FROM orders")
def bin_roundtrip_raw(spark, d):
    v = vector(spark, d, "orders", (F.col("o_custkey") % 256).cast("smallint"), "o_orderkey", "raw")
    binary.store(path := f"{scratch(spark, 'bin')}/v.bin", v)
    return binary.read(spark, path, "raw").to_df().withColumn("value", F.col("value").cast("int"))


@query("bin_roundtrip_cplx", f"SELECT idx, price AS re, CAST(i AS DOUBLE) AS im FROM {_ORDERS}")
def bin_roundtrip_cplx(spark, d):
    price, i = _pair(spark, d, "price", "i")
    z = price.map(F.struct(price.value.alias("re"), i.value.cast("double").alias("im")), "complex")
    binary.store(path := f"{scratch(spark, 'bin')}/v.bin", z)
    return binary.read(spark, path, "complex").to_df().select("idx", "value.re", "value.im")


def _matrix(spark, d):
    """All prices as a file-backed, column-major matrix of 128 rows; what doesn't fill a column is left out."""
    v = _orders(spark, d, "price")
    binary.store(path := f"{scratch(spark, 'mat')}/m.bin", v)
    return binary.read_matrix(spark, path, "numeric", 128, v.length // 128)


_COLS = "((SELECT count(*) FROM orders) // 128)"


@query("mat_cell", f"SELECT CAST(1 AS BIGINT) AS idx, price AS value FROM {_ORDERS} WHERE idx = 4 * 128 + 17")
def mat_cell(spark, d):
    return _matrix(spark, d)[17, 5].to_df()


@query("mat_colsum", f"SELECT (idx - 1) // 128 + 1 AS j, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents FROM {_ORDERS} WHERE idx <= 128 * {_COLS} GROUP BY 1")
def mat_colsum(spark, d):
    return _matrix(spark, d).cells().groupBy("j").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def _csv_file(spark, d, name: str, header: list[str], columns: list[Column]) -> str:
    """A CSV file written on the driver, row by row."""
    path = f"{scratch(spark, 'csv')}/{name}.csv"
    rows = table(spark, d, "customer").orderBy("c_custkey").select(F.concat_ws(",", *columns).alias("line"))
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows.toLocalIterator():
            f.write(r["line"] + "\n")
    return path


def _quoted(c: str):
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def _csv_cells():
    odd = F.col("c_custkey") % 3 == 0
    return ["key", "name", "acct bal", "flag", "none"], [F.col("c_custkey").cast("string"), _quoted("c_name"), F.when(odd, "NA").otherwise(F.col("c_acctbal").cast("string")), F.when(odd, "T").otherwise("FALSE"), F.when(odd, "NA").otherwise("")]


for _dialect in ("exact", "standard"):

    def _csv_round_trip(spark, d, dialect=_dialect):
        return csv.read(spark, _csv_file(spark, d, "t", *_csv_cells()), dialect=dialect).to_df()

    query("csv_roundtrip" + ("_standard" if _dialect == "standard" else ""), 'SELECT c_custkey + 1 AS idx, CAST(c_custkey AS INTEGER) AS key, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS "acct.bal", c_custkey % 3 = 0 AS flag, CAST(NULL AS BOOLEAN) AS none FROM customer')(_csv_round_trip)


@query("csv_infer", "SELECT * FROM (VALUES ('key', 'integer'), ('name', 'character'), ('acct.bal', 'numeric'), ('flag', 'logical'), ('none', 'logical')) t(name, kind)")
def csv_infer(spark, d):
    kinds = csv.read(spark, _csv_file(spark, d, "t", *_csv_cells())).kinds
    return spark.createDataFrame(list(kinds.items()), "name string, kind string")


@query("source_generated", "SELECT CAST(r AS BIGINT) AS idx, CAST((r - 1) * (r - 1) % 1000 AS DOUBLE) AS value FROM range(1, 300001) t(r)")
def source_generated(spark, d):
    return generate.generated(spark, lambda a, b: (np.arange(a, b) ** 2 % 1000).astype(float), 300_000, "numeric", 4096).to_df()


# -- casts ------------------------------------------------------------------------------------------
def _cast(name, source, target, value, sql, sql_type):
    def run(spark, d):
        v = vector(spark, d, "orders", value(), "o_orderkey", source)
        return v.cast(target).to_df()

    query(name, f"SELECT o_orderkey + 1 AS idx, CAST({sql} AS {sql_type}) AS value FROM orders")(run)


_cast("cast_real_int", "numeric", "integer", lambda: F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-20000.0), "CASE WHEN abs(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -20000.0 END) < 2147483647 THEN trunc(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -20000.0 END) END", "INTEGER")
_cast("cast_str_int", "character", "integer", lambda: F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(".7 ")), "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END", "INTEGER")
_cast("cast_str_real", "character", "numeric", lambda: F.when(F.col("o_orderkey") % 4 == 0, "0x1F").when(F.col("o_orderkey") % 4 == 1, "NA").otherwise(F.col("o_totalprice").cast("string")), "CASE o_orderkey % 4 WHEN 0 THEN 31.0 WHEN 1 THEN NULL ELSE o_totalprice END", "DOUBLE")
_cast("cast_str_lgl", "character", "logical", lambda: F.element_at(F.array(*map(F.lit, ["T", "false", "yes", "TRUE", "1"])), (F.col("o_orderkey") % 5 + 1).cast("int")), "CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE END", "BOOLEAN")
_cast("cast_lgl_int", "logical", "integer", lambda: F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "F"), "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderstatus = 'F' AS INTEGER) END", "INTEGER")
_cast("cast_int_str", "integer", "character", lambda: F.col("o_custkey").cast("int"), "o_custkey", "VARCHAR")
_cast("cast_lgl_str", "logical", "character", lambda: F.col("o_orderstatus") == "F", "CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END", "VARCHAR")
_cast("cast_raw_str", "raw", "character", lambda: (F.col("o_orderkey") % 256).cast("smallint"), "lower(lpad(to_hex(o_orderkey % 256), 2, '0'))", "VARCHAR")
_cast("cast_int_lgl", "integer", "logical", lambda: (F.col("o_orderkey") % 3).cast("int"), "o_orderkey % 3 <> 0", "BOOLEAN")
_cast("cast_int_real", "integer", "numeric", lambda: F.col("o_custkey").cast("int"), "o_custkey", "DOUBLE")


@query("cast_cplx", f"SELECT idx, CAST(i AS DOUBLE) AS re, CAST(2.5 AS DOUBLE) AS im, CAST(i AS INTEGER) AS whole, TRUE AS truth FROM {_ORDERS}")
def cast_cplx(spark, d):
    text = F.concat(((F.col("o_orderkey") % 1000) - 500).cast("string"), F.lit("+2.5i"))
    z = vector(spark, d, "orders", text, "o_orderkey", "character").cast("complex")
    return z.frame.select("idx", z.value.re.alias("re"), z.value.im.alias("im"), z.cast("integer").value.alias("whole"), z.cast("logical").value.alias("truth"))


# -- apply and reductions ---------------------------------------------------------------------------
@query("apply_udf", f"SELECT o.idx, o.price + 2 * p.p_size AS value FROM {_ORDERS} o JOIN part p ON p.p_partkey = (o.idx - 1) % (SELECT count(*) FROM part)")
def apply_udf(spark, d):
    return apply(lambda a, b, k: a + k * b, _orders(spark, d, "price"), vector(spark, d, "part", "p_size", "p_partkey"), kind="numeric", more_args={"k": 2}).to_df()


@query("chunk_recycled", "SELECT CAST(r AS BIGINT) AS idx, p_retailprice AS value FROM range(100001, 150001) t(r) JOIN part ON p_partkey = (r - 1) % (SELECT count(*) FROM part)")
def chunk_recycled(spark, d):
    return chunk(vector(spark, d, "part", "p_retailprice", "p_partkey"), 3, 50_000, 1_000_000)


@query("sum_na", f"SELECT CASE WHEN count(*) = count(j) THEN CAST(sum(j) AS BIGINT) END AS sum FROM {_ORDERS}")
def sum_na(spark, d):
    return _orders(spark, d, "j").sum()


@query("sum_na_rm", f"SELECT CAST(sum(j) AS BIGINT) AS sum FROM {_ORDERS}")
def sum_na_rm(spark, d):
    return _orders(spark, d, "j").sum(na_rm=True)


@query("min_max", f"SELECT min(j) AS min, max(j) AS max FROM {_ORDERS}")
def min_max(spark, d):
    v = _orders(spark, d, "j")
    return v.min(na_rm=True).crossJoin(v.max(na_rm=True))  # one row each


@query("delayed_sum", "SELECT round(sum(o_totalprice + 1), 2) AS sum FROM orders")
def delayed_sum(spark, d):
    return (_orders(spark, d, "price") + 1).sum().select(F.round("sum", 2).alias("sum"))


@query("difference", f"SELECT count(*) AS n_different FROM {_ORDERS} WHERE i IS DISTINCT FROM j")
def difference(spark, d):
    return vec.difference(_orders(spark, d, "i"), _orders(spark, d, "j"))


@query("column_sums", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def column_sums(spark, d):
    # only expressions are made of these vectors: positions, which the table has none of, are never asked for
    li = table(spark, d, "lineitem").withColumn("idx", F.monotonically_increasing_id() + 1)
    price, off = Vector(li, "l_extendedprice", "numeric"), Vector(li, "l_discount", "numeric")
    net = price * (1 - off)
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.round(net.value * 10000).cast("bigint")).alias("total"))


# -- more sources: strict sequences, raw zeros, the CSV dialect -----------------------------------------
@query("seq_strict", "SELECT CAST(r AS BIGINT) AS idx, CAST(5 + (r - 1) * 3 AS INTEGER) AS value FROM range(1, 3333) t(r)")
def seq_strict(spark, d):
    return generate.sequence(spark, 5, 10_000, 3, strict=True).to_df()


def _refused(spark, cases: dict) -> DataFrame:
    """Which cases raise an error, by name."""
    rows = []
    for name, case in cases.items():
        try:
            case()
            rows.append((name, False))
        except (ValueError, IndexError, TypeError):
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


@query("seq_strict_errors", "SELECT * FROM (VALUES ('down', TRUE), ('equal', TRUE), ('by zero', TRUE), ('by negative', TRUE), ('up', FALSE)) t(name, refused)")
def seq_strict_errors(spark, d):
    make = lambda *a: lambda: generate.sequence(spark, *a, strict=True)
    return _refused(spark, {"down": make(5, 1), "equal": make(5, 5), "by zero": make(1, 5, 0), "by negative": make(1, 5, -1), "up": make(1, 5)})


@query("const_raw", "SELECT CAST(r AS BIGINT) AS idx, CAST(0 AS INTEGER) AS value FROM range(1, 1001) t(r)")
def const_raw(spark, d):
    return generate.constant(spark, "raw", 1000, True).to_df().withColumn("value", F.col("value").cast("int"))


def _csv_lines(spark, d, name: str, lines: Column, end: str = "\n", head: str = "") -> str:
    """A CSV file with a line of customer's for each row, written on the driver; end: after each."""
    path = f"{scratch(spark, 'csv')}/{name}.csv"
    rows = table(spark, d, "customer").orderBy("c_custkey").select(lines.alias("line"))
    with open(path, "w", newline="") as f:
        f.write(head)
        for r in rows.toLocalIterator():
            f.write(r["line"] + end)
    return path


def _csv_query(name: str, sql: str, lines, end: str = "\n", head: str = "a,b\n", **options):
    def run(spark, d):
        return csv.read(spark, _csv_lines(spark, d, name, lines(), end, head), **options).to_df()

    query(name, sql)(run)


_key, _text = lambda: F.col("c_custkey").cast("string"), lambda c: F.lit(c)
_CUSTOMERS = "SELECT c_custkey + 1 AS idx, CAST(c_custkey AS INTEGER) AS a, {} AS b FROM customer"
_csv_query("csv_blanks", _CUSTOMERS.format("CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '  ' || c_name || ' ' END"),
           lambda: F.concat(F.lit(" \t"), _key(), F.lit(" \t, "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_name"), F.lit("  "))).otherwise(F.concat(F.lit('  "  '), F.col("c_name"), F.lit(' "  ')))))
_csv_query("csv_doubled_quotes", _CUSTOMERS.format("'\"' || c_name || '\"\"'"), lambda: F.concat(_key(), F.lit(',"""'), F.col("c_name"), F.lit('"""""')))
_csv_query("csv_backslashes", _CUSTOMERS.format("c_name || chr(92) || '\"' || chr(92) || 'n' || chr(92)"), lambda: F.concat(_key(), F.lit(',"'), F.col("c_name"), F.lit('\\"\\n\\\\"')))
_csv_query("csv_newline_in_quotes", _CUSTOMERS.format("c_name || chr(10) || 'x,y'"), lambda: F.concat(_key(), F.lit(',"'), F.col("c_name"), F.lit('\nx,y"')))
_csv_query("csv_literal_quote", _CUSTOMERS.format("c_name || '\"x\"'"), lambda: F.concat(_key(), F.lit(","), F.col("c_name"), F.lit('"x"')))
_csv_query("csv_crlf", _CUSTOMERS.format("c_name"), lambda: F.concat(_key(), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(","), F.col("c_name"))).otherwise(F.concat(F.lit(',"'), F.col("c_name"), F.lit('"')))), end="\r\n")
_csv_query("csv_ragged", "SELECT c_custkey + 1 AS idx, CAST(c_custkey AS INTEGER) AS a, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS b, CASE WHEN c_custkey % 3 = 2 THEN CAST(c_nationkey AS INTEGER) END AS \"X\" FROM customer",
           lambda: F.concat(_key(), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(","), F.col("c_name"))), F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit(","), F.col("c_nationkey").cast("string"))).otherwise("")))
_csv_query("csv_blank_lines", "SELECT 2 * c_custkey + 1 + h AS idx, CASE WHEN h = 0 THEN CAST(c_custkey AS INTEGER) END AS a, CASE WHEN h = 0 THEN c_name ELSE '' END AS b FROM customer, (VALUES (0), (1)) t(h)",
           lambda: F.concat(_key(), F.lit(","), F.col("c_name"), F.lit("\n")))
_csv_query("csv_no_header", "SELECT c_custkey + 1 AS idx, CAST(c_custkey AS INTEGER) AS \"V1\", c_name AS \"V2\" FROM customer", lambda: F.concat(_key(), F.lit(","), F.col("c_name")), head="", header=False)


@query("csv_header_only", "SELECT * FROM (VALUES ('a', 'logical', 0), ('b', 'logical', 0)) t(name, kind, n)")
def csv_header_only(spark, d):
    path = f"{scratch(spark, 'csv')}/h.csv"
    with open(path, "w") as f:
        f.write("a,b")
    t = csv.read(spark, path)
    return spark.createDataFrame([(n, k, len(t)) for n, k in t.kinds.items()], "name string, kind string, n int")


@query("csv_errors", "SELECT * FROM (VALUES ('text after a quote', TRUE), ('open quote', TRUE), ('end after a quote', FALSE)) t(name, refused)")
def csv_errors(spark, d):
    cases = {"text after a quote": 'a\n"x"y\n', "open quote": 'a\n"x\n', "end after a quote": 'a\n"x"'}
    return _refused(spark, {name: lambda text=text: list(csv.parse(text)) for name, text in cases.items()})


# -- more subscripts -------------------------------------------------------------------------------------
@query("sub_errors", "SELECT * FROM (VALUES ('mixed signs', TRUE), ('negative and missing', TRUE), ('complex', TRUE), ('negative and zero', FALSE)) t(name, refused)")
def sub_errors(spark, d):
    x, z = _orders(spark, d, "price"), generate.constant(spark, "complex", 1)
    cases = {"mixed signs": [-1, 1], "negative and missing": [-1, None], "complex": z, "negative and zero": [-1, 0]}
    return _refused(spark, {name: lambda s=s: index.subscript(x, s) for name, s in cases.items()})


_sub("sub_no_names", "SELECT event_id + 1 AS k, CAST(NULL AS BIGINT) AS pos FROM events", lambda spark, d: vector(spark, d, "events", "event_type", "event_id"))


@query("sub_lengths", f"SELECT * FROM (VALUES ('mask', (SELECT count(*) FILTER (f IS NULL OR f) FROM {_ORDERS})), ('recycled', (SELECT count(*) FILTER (idx % 3 <> 2) FROM {_ORDERS})), ('positive', (SELECT count(*) FILTER (user_id % 7 > 0) FROM events)), ('negative', (SELECT count(*) FROM {_ORDERS} WHERE idx NOT IN (SELECT user_id + 1 FROM events))), ('slice', CAST(100 AS BIGINT))) t(name, n)")
def sub_lengths(spark, d):
    x, f = _pair(spark, d, "price", "f")
    events = lambda c: vector(spark, d, "events", c.cast("int"), "event_id")
    cases = {"mask": f, "recycled": [True, False, True], "positive": events(F.col("user_id") % 7), "negative": events(-F.col("user_id") - 1), "slice": slice(11, 210, 2)}
    return spark.createDataFrame([(name, index.subscript_length(x, s)) for name, s in cases.items()], "name string, n bigint")


# -- arrays ----------------------------------------------------------------------------------------------
@query("mat_rows", f"SELECT (idx - 1) // 128 * 3 + r.o AS idx, price AS value FROM {_ORDERS} JOIN (VALUES (1, 3), (2, 1), (3, 128)) r(o, i) ON (idx - 1) % 128 + 1 = r.i WHERE idx <= 128 * {_COLS}")
def mat_rows(spark, d):
    return _matrix(spark, d)[[3, 1, 128], :].to_df()


@query("mat_block", f"SELECT (idx - 1) // 128 * 5 - 4 + ((idx - 1) % 128 - 9) // 2 AS idx, price AS value FROM {_ORDERS} WHERE (idx - 1) // 128 + 1 BETWEEN 2 AND 6 AND (idx - 1) % 128 + 1 IN (10, 12, 14, 16, 18)")
def mat_block(spark, d):
    return _matrix(spark, d)[10:18:2, 2:6].to_df()


@query("array_extract", f"SELECT ((idx - 1) % 16) // 4 * 2 + (CASE (idx - 1) % 4 WHEN 1 THEN 1 ELSE 2 END) + ((idx - 1) // 16) * 8 AS idx, price AS value FROM {_ORDERS} WHERE (idx - 1) % 4 IN (1, 3) AND idx <= 16 * ((SELECT count(*) FROM orders) // 16)")
def array_extract(spark, d):
    v = _orders(spark, d, "price")
    return v.reshape(4, 4, v.length // 16)[[2, 4], :, :].to_df()


# -- more casts ------------------------------------------------------------------------------------------
_ODD = "CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice) * 100000.0 WHEN 2 THEN o_totalprice / 1e10 WHEN 3 THEN -floor(o_totalprice) WHEN 4 THEN o_totalprice * 1e15 ELSE 0.0 END"
_SHOWN = """
SELECT idx, CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN greatest(e + 1, 1) + CASE WHEN n > e + 1 THEN n - e ELSE 0 END <= CASE WHEN n > 1 THEN n + 1 ELSE 1 END + 4
  THEN CASE WHEN e < 0 THEN '0.' || repeat('0', -e - 1) || m WHEN n > e + 1 THEN substr(m, 1, e + 1) || '.' || substr(m, e + 2) ELSE rpad(m, e + 1, '0') END
  ELSE substr(m, 1, 1) || CASE WHEN n > 1 THEN '.' || substr(m, 2) ELSE '' END || CASE WHEN e < 0 THEN 'e-' ELSE 'e+' END || lpad(CAST(abs(e) AS VARCHAR), 2, '0') END AS value
FROM (SELECT *, length(m) AS n FROM (SELECT idx, x, CASE WHEN x = 0 THEN '0' ELSE rtrim(replace(split_part(s, 'e', 1), '.', ''), '0') END AS m, CAST(split_part(s, 'e', 2) AS INTEGER) AS e
  FROM (SELECT idx, x, printf('%.14e', abs(x)) AS s FROM ({}))))"""


@query("cast_real_str", _SHOWN.format(f"SELECT o_orderkey + 1 AS idx, {_ODD} AS x FROM orders"))
def cast_real_str(spark, d):
    return vector(spark, d, "orders", F.expr(_ODD.replace("o_totalprice / 1e10", "o_totalprice / 1e10D").replace("1e15", "1e15D").replace("100000.0", "1e5D").replace("0.0", "0.0D")), "o_orderkey", "numeric").cast("character").to_df()


@query("cast_cplx_str", "SELECT o_orderkey + 1 AS idx, CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '+1.5i' ELSE '-2i' END AS value FROM orders")
def cast_cplx_str(spark, d):
    z = F.struct(F.col("o_custkey").cast("double").alias("re"), F.when(F.col("o_orderkey") % 2 == 0, 1.5).otherwise(-2.0).alias("im"))
    return vector(spark, d, "orders", z, "o_orderkey", "complex").cast("character").to_df()


@query("cast_cplx_real", f"SELECT idx, price AS value FROM {_ORDERS}")
def cast_cplx_real(spark, d):
    price, i = _pair(spark, d, "price", "i")
    return price.map(F.struct(price.value.alias("re"), i.value.cast("double").alias("im")), "complex").cast("numeric").to_df()


_cast("cast_raw_raw", "raw", "raw", lambda: (F.col("o_orderkey") % 256).cast("smallint"), "o_orderkey % 256", "SMALLINT")


@query("cast_refusals", "SELECT a || ' to ' || b AS name, a <> b AND (a = 'raw' AND b <> 'character' OR b = 'raw') AS refused FROM (VALUES ('logical'), ('integer'), ('numeric'), ('complex'), ('character'), ('raw')) s(a), (VALUES ('logical'), ('integer'), ('numeric'), ('complex'), ('character'), ('raw')) t(b)")
def cast_refusals(spark, d):
    kinds = ("logical", "integer", "numeric", "complex", "character", "raw")
    one = {k: generate.constant(spark, k, 1) for k in kinds}
    return _refused(spark, {f"{a} to {b}": lambda a=a, b=b: one[a].cast(b) for a in kinds for b in kinds})


# -- lengths, loops, membership, chunks ------------------------------------------------------------------
@query("length", "SELECT * FROM (VALUES ('orders', (SELECT count(*) FROM orders)), ('sequence', CAST(14 AS BIGINT)), ('every second order', (SELECT count(*) // 2 FROM orders))) t(name, n)")
def length(spark, d):
    x = _orders(spark, d, "price")
    return spark.createDataFrame([("orders", len(x)), ("sequence", len(generate.sequence(spark, 1, 40, 3))), ("every second order", len(x[2::2]))], "name string, n bigint")


@query("element_loop", f"SELECT CAST(sum(idx * (i + 501)) AS BIGINT) AS weighted, count(*) AS n FROM {_ORDERS}")
def element_loop(spark, d):
    total, n = _orders(spark, d, "i").fold((0, 0), lambda s, k, v: (s[0] + k * (v + 501), s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return spark.createDataFrame([(total, n)], "weighted bigint, n bigint")


@query("is_vector", "SELECT * FROM (VALUES ('vector', TRUE), ('sum of vectors', TRUE), ('frame', FALSE), ('number', FALSE)) t(name, yes)")
def is_vector(spark, d):
    x = _orders(spark, d, "price")
    return spark.createDataFrame([(n, vec.is_vector(v)) for n, v in (("vector", x), ("sum of vectors", x + x), ("frame", x.frame), ("number", 1.5))], "name string, yes boolean")


@query("member", f"SELECT idx, s IN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END FROM orders WHERE o_orderkey < 9 AND o_orderkey % 2 = 0) AS value FROM {_ORDERS}")
def member(spark, d):
    x = _orders(spark, d, "s")
    return x.is_in(x[1:9:2]).to_df()


@query("member_missing", f"SELECT idx, j IS NULL OR j IN (1, 2) AS value FROM {_ORDERS}")
def member_missing(spark, d):
    return _orders(spark, d, "j").is_in(index.from_values(spark, [1.0, None, 2.0])).to_df()


@query("member_count", f"SELECT count(*) AS n FROM {_ORDERS} WHERE idx IN (SELECT user_id FROM events)")
def member_count(spark, d):
    x = vector(spark, d, "orders", (F.col("o_orderkey") + 1).cast("int"), "o_orderkey")
    return index.count_members(x, vector(spark, d, "events", "user_id", "event_id"))


@query("apply_chunks", f"SELECT idx, CAST(sum(i) OVER (PARTITION BY (idx - 1) // 1000 ORDER BY idx) AS BIGINT) AS value, s AS name FROM {_ORDERS}")
def apply_chunks(spark, d):
    i, s = _pair(spark, d, "i", "s")
    out = apply(lambda x: x.cumsum(), i.set_names(s.value), chunk_size=1000)
    return out.frame.select("idx", F.col("value").cast("bigint").alias("value"), "name")


@query("chunk_bounds", "SELECT CAST(r AS INTEGER) AS number, (r - 1) * 700 + 1 AS first, least(r * 700, (SELECT count(*) FROM part)) AS last FROM range(1, CAST((SELECT ceil(count(*) / 700) FROM part) AS BIGINT) + 1) t(r)")
def chunk_bounds_(spark, d):
    x = vector(spark, d, "part", "p_retailprice", "p_partkey")
    rows = [(k + 1, *chunk_bounds(x, k + 1, 700)) for k in range(-(-x.length // 700))]
    return spark.createDataFrame(rows, "number int, first bigint, last bigint")
