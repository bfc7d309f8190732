"""Queries of the llm operators over the test tables, with production parameters, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import handwritten, leakage, mixing, neardup, secrets, spam, spans


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = handwritten.file_evidence(table(spark, sf_dir, "files"), table(spark, sf_dir, "functions"))
    return handwritten.not_handwritten(evidence).select("file_id")


def _linked_functions(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(neardup.function_texts(table(spark, sf_dir, "functions")), "id", "text", k=4, threshold=0.7, min_words=30)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _linked_functions(spark, sf_dir).pairs()
    return pairs.select(F.col("id_a").alias("function_id_a"), F.col("id_b").alias("function_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per function with its class of equal texts and the number of other classes it is linked to."""
    return _linked_functions(spark, sf_dir).memberships()


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between classes."""
    return _linked_functions(spark, sf_dir).links.select("rep_a", "rep_b", F.round("similarity", 6).alias("similarity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spans.code_records(table(spark, sf_dir, "functions"), table(spark, sf_dir, "routes"))
    return spans.named_records(spans.shared_spans(records, "rec", "text"))


def p3_shared_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spans.code_records(table(spark, sf_dir, "functions"), table(spark, sf_dir, "routes"))
    found = spans.shared_spans(records, "rec", "text")
    return spans.named_records(spans.shared_amount(records, found, "rec", "text")).select("record_kind", "record_id", "n_chars", "shared_chars")


def _code_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Constants and functions; a function that was delivered again has the same body, so its spans are the same."""
    return table(spark, sf_dir, "constants").select("id", "name", "value_text"), table(spark, sf_dir, "functions").select("id", "body")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    constants, functions = _code_texts(spark, sf_dir)
    a = secrets.find_secrets(constants, "id", "value_text", "name").withColumn("record_kind", F.lit("constant"))
    b = secrets.find_secrets(functions, "id", "body").withColumn("record_kind", F.lit("function"))
    return a.unionByName(b).select("record_kind", F.col("id").alias("record_id"), "secret_start", "secret_len")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    constants, functions = _code_texts(spark, sf_dir)
    a = secrets.redact_secrets(constants, "id", "value_text", "name").withColumn("record_kind", F.lit("constant"))
    b = secrets.redact_secrets(functions, "id", "body").withColumn("record_kind", F.lit("function"))
    return a.unionByName(b).select("record_kind", F.col("id").alias("record_id"), "text", "n_secrets").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", ["question", "answer"])
    return hits.select("doc_id", "item_id").distinct()


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, targets = mixing.mix_inputs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixing.mixed_documents(counted, mixing.raked_weights(counted, targets))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, targets = mixing.mix_inputs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    weights = mixing.raked_weights(counted, targets)
    mixed = written(mixing.mixed_documents(counted, weights), "mixing-mixed")
    return mixing.mix_report(mixed, counted, targets, weights)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = spam.page_spam_evidence(table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "package"])
    return spam.spam_pages(evidence).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_classes, p2_links, p3_found, p3_shared_amount, p4_found, p4_redacted, p6_found, p7_mix, p7_shares, p8_found)}

_RECORDS = """
recs AS (SELECT 'function' AS record_kind, id AS record_id, any_value(body) AS t FROM functions GROUP BY id
         UNION ALL SELECT 'route', id, any_value(handler_body) FROM routes GROUP BY id),
pos AS (SELECT record_kind, record_id, t, unnest(range(0, length(t) - 119)) AS p FROM recs WHERE length(t) >= 120),
win AS (SELECT record_kind, record_id, p, md5(substring(t, p + 1, 120)) AS h FROM pos),
dup AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT record_kind || record_id) > 1),
hit AS (SELECT record_kind, record_id, p FROM win SEMI JOIN dup USING (h)),
gap AS (SELECT *, CASE WHEN p - lag(p) OVER w <= 120 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY record_kind, record_id ORDER BY p)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY record_kind, record_id ORDER BY p) AS g FROM gap),
spans AS (SELECT record_kind, record_id, min(p) AS span_start, max(p) + 120 - min(p) AS span_len FROM run GROUP BY record_kind, record_id, g)
"""

_PAIRS = """
WITH f AS (SELECT id, any_value(coalesce(signature, '') || ' ' || coalesce(body, '')) AS t FROM functions GROUP BY id),
w AS (SELECT id, regexp_extract_all(t, '[A-Za-z0-9_]+') AS w FROM f),
cl AS (SELECT id, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep FROM w WHERE len(w) >= 30),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) AS g FROM w WHERE len(w) >= 30),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pa AS (SELECT c.a, c.b, c.k::DOUBLE / (x.n + y.n - c.k) AS similarity FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE c.k::DOUBLE / (x.n + y.n - c.k) >= 0.7),
li AS (SELECT a AS rep_a, b AS rep_b, similarity FROM pa WHERE a IN (SELECT rep FROM cl) AND b IN (SELECT rep FROM cl))
"""

ORACLE = {
    "p2_found": _PAIRS + "SELECT a AS function_id_a, b AS function_id_b FROM pa",
    "p2_links": _PAIRS + "SELECT rep_a, rep_b, round(similarity, 6) AS similarity FROM li",
    "p2_classes": _PAIRS + "SELECT id, rep, (SELECT count(*) FROM li WHERE rep_a = rep OR rep_b = rep) AS n_links FROM cl",
    "p3_found": f"WITH {_RECORDS} SELECT record_kind, record_id, span_start::BIGINT AS span_start, span_len::BIGINT AS span_len FROM spans",
    "p3_shared_amount": f"""WITH {_RECORDS}, per AS (SELECT record_kind, record_id, sum(span_len)::BIGINT AS shared_chars FROM spans GROUP BY ALL)
SELECT record_kind, record_id, coalesce(length(t), 0)::BIGINT AS n_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars FROM recs LEFT JOIN per USING (record_kind, record_id)""",
    "p6_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(question, '') || ' ' || coalesce(answer, '')), '[\p{L}\p{N}]+') AS w FROM eval_items),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, md5(array_to_string(w[k:k+12], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
dg AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k+12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
