"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.common import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINES_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id"""


@query("op2_line_dedup", f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({LINES_SQL})")
def op2(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_packing")
def op6(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.packing import pack

    return pack(table(spark, d, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.common import remainder
    from stratavec.llm.language import fit, identify, training_rows

    docs = table(spark, d, "documents")
    out = identify(docs, fit(training_rows(docs)))
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "known")


@query("op10_decontamination")
def op10(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.decontamination import overlaps

    return overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op8_toxicity")
def op8(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm import toxicity as t
    from stratavec.llm.common import remainder

    docs = table(spark, d, "documents")
    out = t.score(docs, t.fit(t.training_rows(docs, table(spark, d, "labels"))))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= t.THRESHOLD).cast("int").alias("predicted"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5"""


@query("op5_topk", TOPK_SQL)
def op5(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.topk import quantised, top_k

    v = quantised(table(spark, d, "embeddings"))
    return top_k(v, v.where("vec_id % 50 = 0"), 5)


@query("op7_pii")
def op7(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.pii import pseudonymise

    return pseudonymise(table(spark, d, "documents"), b"a key for these tables").select("doc_id", F.size("entities").alias("n_entities"), "text")


@query("op4_secrets")
def op4(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.secrets import frequent_words, labelled_findings, scan, train

    docs = table(spark, d, "documents")
    dictionary = frequent_words(docs)
    return scan(docs, train(labelled_findings(), dictionary), dictionary)


@query("op3_jaccard_join")
def op3(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm.jaccard_join import similar_components

    return similar_components(table(spark, d, "documents"))


@query("op1_lm_scoring")
def op1(spark: SparkSession, d: str) -> DataFrame:
    from stratavec.llm import hmm
    from stratavec.llm.common import remainder

    docs = table(spark, d, "documents")
    model, v, counts = hmm.fit(docs.where(remainder(7) != 2))
    out = hmm.score(docs, model, v, counts)
    return out.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("pipeline")
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
