"""Inputs derived from the driver tables.

Each view in ``VIEWS`` is one SELECT that means the same in Spark SQL and DuckDB.
Spark reads the tables by path, so nothing is registered in the session. Nested
tasks are built in Spark only; their flat twins here carry the same values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_DAY = "CAST(CAST(o.o_orderdate AS DATE) AS STRING)"
_BAL = "CAST(c.c_acctbal AS STRING)"

VIEWS: dict[str, str] = {
    "event_store": f"""
SELECT event_id AS id, concat('wf-', CAST(user_id % 4 AS STRING)) AS workflow_id,
  CAST(user_id AS INT) AS organization_id,
  concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS execution_id,
  ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'WorkflowExecutionStarted'
    WHEN 'purchase' THEN 'WorkflowExecutionCompleted' WHEN 'error' THEN 'WorkflowExecutionFailed'
    ELSE 'WorkflowExecutionStepCompleted' END AS event_type,
  CASE WHEN event_type = 'error' THEN CASE WHEN {_K} % 2 = 0
    THEN 'RetryableException' ELSE 'ValueError' END END AS error_type,
  {_K} % 4 AS retry_count, CAST(floor(value * 10) AS BIGINT) AS execution_time_ms,
  concat('step_', CAST(event_id % 6 AS STRING)) AS step_name,
  concat('file-', CAST(event_id AS STRING), '.pdf') AS s3_file_info, props AS metadata,
  CASE WHEN {_K} % 10 = 0 THEN 'DONE' ELSE 'PENDING' END AS anonymization_status
FROM events""",
    "value_pairs": f"""
SELECT o.o_orderkey AS id, {_BAL} AS expected_number,
  CASE o.o_orderkey % 5 WHEN 0 THEN {_BAL} WHEN 1 THEN replace({_BAL}, '.', ',')
    WHEN 2 THEN concat({_BAL}, ' €') WHEN 3 THEN NULL ELSE '1.2.3' END AS predicted_number,
  {_DAY} AS expected_date,
  CASE o.o_orderkey % 4
    WHEN 0 THEN concat(substr({_DAY}, 9, 2), '/', substr({_DAY}, 6, 2), '/', substr({_DAY}, 1, 4))
    WHEN 1 THEN replace({_DAY}, '-', '') WHEN 2 THEN '31/02/2024' ELSE NULL END AS predicted_date,
  c.c_name AS expected_name,
  CASE o.o_orderkey % 6 WHEN 0 THEN lower(c.c_name) WHEN 1 THEN replace(c.c_name, '#', '-')
    WHEN 2 THEN substr(c.c_name, 1, 12) WHEN 3 THEN concat('M. ', c.c_name) WHEN 4 THEN NULL
    ELSE 'Élodie Martin' END AS predicted_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "text_pairs": """
SELECT conv_id * 1000 + turn AS id, text AS expected_text,
  CASE turn % 4 WHEN 0 THEN lower(text) WHEN 1 THEN replace(text, ' ', '-')
    WHEN 2 THEN concat('Fin. ', replace(text, 'ou', 'eau')) ELSE NULL END AS predicted_text
FROM conversations""",
    "document_pairs": """
SELECT doc_id AS id, text AS expected_text,
  CASE doc_id % 4 WHEN 0 THEN lower(text) WHEN 1 THEN replace(text, ' ', '-')
    WHEN 2 THEN replace(text, 'ou', 'eau') ELSE NULL END AS predicted_text
FROM documents""",
    "task_flags": """
SELECT c_custkey AS task_id, CAST(c_nationkey AS BIGINT) AS project,
  concat('s3://bucket/doc-', CAST(c_custkey AS STRING), '.pdf') AS pdf,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'autre' ELSE 'cni' END AS document_type,
  c_custkey % 13 <> 0 AS has_truth, c_custkey % 17 <> 0 AS has_predictions,
  c_custkey % 2 = 0 AS completed
FROM customer""",
    "label_pairs": f"""
SELECT c.c_custkey AS task_id, concat('model-', m.mv) AS model_version,
  c.c_custkey * 10 + m.mk AS prediction_id, f.field,
  CASE f.field WHEN 'nom' THEN c.c_name WHEN 'numero_document' THEN CAST(c.c_custkey AS STRING)
    WHEN 'nationalite' THEN c.c_mktsegment ELSE {_BAL} END AS expected,
  CASE WHEN (c.c_custkey + m.mk) % 7 = 0 THEN NULL
    WHEN f.field = 'nom' AND (c.c_custkey + m.mk) % 3 = 0 THEN lower(c.c_name)
    WHEN f.field = 'nom' THEN replace(c.c_name, '0', 'O')
    WHEN f.field = 'numero_document' THEN concat(' ', CAST(c.c_custkey AS STRING), ' N')
    WHEN f.field = 'nationalite' AND (c.c_custkey + m.mk) % 5 = 0 THEN 'OTHER'
    WHEN f.field = 'nationalite' THEN c.c_mktsegment ELSE {_BAL} END AS predicted,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL
    ELSE CAST(c.c_custkey % 900 + 100 * m.mk AS BIGINT) END AS processing_time_ms
FROM customer c JOIN (SELECT 'a' AS mv, 1 AS mk UNION ALL SELECT 'b', 2) m ON c.c_custkey IS NOT NULL
JOIN (SELECT 'nom' AS field UNION ALL SELECT 'numero_document' UNION ALL SELECT 'nationalite'
  UNION ALL SELECT 'lieu_naissance') f ON c.c_custkey IS NOT NULL""",
    "experiment_runs": """
SELECT o_orderkey AS id, CAST(o_custkey % 10 AS INT) AS label_project_id,
  o_orderpriority AS metric_name, o_orderdate AS created_at,
  CAST(o_orderkey % 9 AS INT) AS total_tasks, CAST(o_orderkey % 5 AS INT) AS processed_count,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status
FROM orders""",
    "observations": """
SELECT l_orderkey AS experiment_id, l_partkey AS task_id, l_linenumber AS prediction_id,
  concat('model-', l_returnflag) AS model_version,
  concat('field_', CAST(l_suppkey % 5 AS STRING)) AS field,
  CASE WHEN l_suppkey % 5 = 4 THEN 'skip' ELSE 'equality' END AS metric,
  CASE WHEN l_suppkey % 5 = 4 THEN -1.0 ELSE CAST(l_discount * 10 AS DOUBLE) END AS score,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 100 AS DOUBLE) END AS processing_time_ms,
  CASE WHEN l_linestatus = 'F' AND l_partkey % 50 = 0 THEN 'comparison failed' END AS error
FROM lineitem""",
    "requests": """
SELECT event_id AS id, concat('key-', CAST(user_id % 3 AS STRING)) AS api_key, ts FROM events""",
    "ocr_pages": """
SELECT conv_id AS execution_id, turn AS page_number, text, role = 'system' AS has_failed
FROM conversations""",
    "barcodes": """
SELECT l_orderkey AS doc_id, l_linenumber % 3 + 1 AS page_number,
  CASE WHEN l_tax > 0.04 THEN 2 ELSE 1 END AS pass, l_linenumber AS pos, l_partkey AS tie,
  CASE l_returnflag WHEN 'A' THEN 'QR' WHEN 'N' THEN 'DATA_MATRIX' ELSE '2D_DOC' END AS type,
  concat('code-', CAST(l_partkey % 4 AS STRING)) AS raw_data
FROM lineitem""",
    "organizations": """
SELECT CAST(r_regionkey AS INT) AS id, r_name AS name,
  CASE WHEN r_regionkey = 0 THEN 'PlatformAdmin' ELSE 'Standard' END AS platform_role FROM region""",
    "api_keys": """
SELECT CAST(n_nationkey AS INT) AS id,
  CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST(n_regionkey AS INT) END AS organization_id,
  n_name AS prefix, CASE WHEN n_nationkey % 4 = 3 THEN 'Revoked' ELSE 'Active' END AS status
FROM nation""",
    "webhooks": """
SELECT s_suppkey AS id, CAST(floor(s_suppkey / 2) AS INT) AS organization_id,
  concat('https://hooks.example.org/', s_name) AS url FROM supplier""",
    "workflow_rows": """
SELECT 'wf-0' AS id,
  'download_file,preprocess_file,extract_content_ocr,llm_classify_document,save_workflow_result' AS steps,
  'albert-large' AS llm_model
UNION ALL SELECT 'wf-1', 'download_file,extract_barcode_raw_data,save_workflow_result', 'albert-small'
UNION ALL SELECT 'wf-2', 'download_file,unknown_step,llm_extract_data,save_workflow_result',
  'openweight-large'""",
    "files": """
SELECT doc_id AS id, concat('doc-', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.pdf'
    WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' ELSE '' END) AS filename,
  CAST(n_chars AS BIGINT) * 4000 AS size,
  CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png'
    ELSE 'text/plain' END AS detected_mime
FROM documents""",
    "messages": f"""
SELECT event_id AS msg_id, ts AS delivered_at,
  CASE WHEN event_id % 17 = 0 THEN '{{bad' ELSE props END AS data, {_K} % 4 AS retries,
  CASE event_type WHEN 'error' THEN 'retryable' WHEN 'click' THEN 'fatal' ELSE 'success' END AS outcome
FROM events""",
}


def _exploded(sql: str) -> str:
    """The two constant lists of ``label_pairs`` as explodes of the row instead of joins."""
    rows = "\nFROM customer c LATERAL VIEW inline(array(named_struct('mv', 'a', 'mk', 1)," \
        " named_struct('mv', 'b', 'mk', 2))) m AS mv, mk LATERAL VIEW" \
        " explode(array('nom', 'numero_document', 'nationalite', 'lieu_naissance')) f AS field"
    return sql[: sql.rindex("\nFROM customer")] + rows


def _label_tasks_sql() -> str:
    """Spark SQL of the nested tasks; their values are those of ``label_pairs``."""
    balance = "CAST(c_acctbal AS STRING)"

    def result(field: str, text: str, readonly: str = "false") -> str:
        return (f"named_struct('value', named_struct('text', array({text})), 'from_name', '{field}',"
                f" 'to_name', 'pdf', 'type', 'textarea', 'readonly', {readonly})")

    def present(*results: str) -> str:
        return f"filter(array({', '.join(results)}), r -> r.value.text[0] IS NOT NULL)"

    def prediction(version: str, mk: int) -> str:
        n = f"(c_custkey + {mk})"

        def unless_gone(text: str) -> str:
            return f"CASE WHEN {n} % 7 <> 0 THEN {text} END"

        name = f"CASE WHEN {n} % 3 = 0 THEN lower(c_name) ELSE replace(c_name, '0', 'O') END"
        time = f"concat('{{\"total_processing_time_ms\":', CAST(c_custkey % 900 + {100 * mk} AS STRING), '}}')"
        results = present(
            result("nom", unless_gone(name)),
            result("numero_document", unless_gone("concat(' ', CAST(c_custkey AS STRING), ' N')")),
            result("nationalite", unless_gone(f"CASE WHEN {n} % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END")),
            result("lieu_naissance", unless_gone(balance)),
            result("__metadata__", f"CASE WHEN c_custkey % 11 <> 0 THEN {time} END", "true"),
        )
        return (f"named_struct('id', c_custkey * 10 + {mk}, 'model_version', 'model-{version}',"
                f" 'result', {results})")

    def annotation(gold: str, who: str, *results: str) -> str:
        return f"named_struct('ground_truth', {gold}, 'completed_by', {who}, 'result', {present(*results)})"

    draft = annotation("false", "CAST(NULL AS STRING)", result("nom", "'draft'"))
    gold = annotation(
        "true", "CASE WHEN c_custkey % 2 = 0 THEN concat('user-', CAST(c_custkey % 5 AS STRING)) END",
        result("nom", "c_name"), result("numero_document", "CAST(c_custkey AS STRING)"),
        result("nationalite", "c_mktsegment"), result("lieu_naissance", balance),
    )
    both = f"array({prediction('a', 1)}, {prediction('b', 2)})"
    return f"""
SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS project,
  named_struct('pdf', concat('s3://bucket/doc-', CAST(c_custkey AS STRING), '.pdf'), 'document_type',
    CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'autre' ELSE 'cni' END) AS data,
  filter(array({draft}, {gold}), (a, i) -> c_custkey % 13 <> 0 AND (i = 1 OR c_custkey % 3 = 0)) AS annotations,
  filter({both}, p -> c_custkey % 17 <> 0) AS predictions
FROM customer"""


class Inputs:
    """Tables and views of one data folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name == "label_pairs":
            return self.spark.sql(self._spark_sql(_exploded(VIEWS[name])))
        if name in VIEWS:
            return self.spark.sql(self._spark_sql(VIEWS[name]))
        raise AttributeError(name)

    def _spark_sql(self, sql: str) -> str:
        def by_path(m: re.Match) -> str:
            return f"{m[1]} parquet.`{self.sf_dir}/{m[2]}.parquet`"

        return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", by_path, sql)

    @property
    def label_tasks(self) -> DataFrame:
        """Nested labelling tasks, one per customer, built inside the row."""
        sql = _label_tasks_sql().replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {customer}")
        return self.spark.sql(sql, customer=spread(self.customer, "c_custkey"))

    @property
    def workflows(self) -> DataFrame:
        return self.workflow_rows.withColumn("steps", F.split("steps", ","))


# --- output shaping shared by the queries --------------------------------------

def at(column: str | Column) -> Column:
    """Time as text with microseconds, the same in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_at(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def r6(column: str | Column) -> Column:
    """Six digits; adding zero turns a rounded-away negative zero into zero."""
    return F.round(column, 6) + F.lit(0.0)


# --- SQL fragments ----------------------------------------------------------------

def sql_number(x: str) -> str:
    return (f"TRY_CAST(nullif(regexp_replace(replace(replace({x}, ' ', ''), ',', '.'),"
            f" '[^0-9.\\-]', '', 'g'), '') AS DOUBLE)")


def sql_fold(x: str) -> str:
    return f"strip_accents(replace(replace(lower({x}), 'œ', 'oe'), 'æ', 'ae'))"


def sql_distance_text(x: str) -> str:
    """Normalised text; the sharp s becomes one byte, since the edit distance counts bytes."""
    return (f"replace(regexp_replace({sql_fold(f'coalesce({x}, {chr(39)}{chr(39)})')},"
            f" '[ \\t\\n\\r.\\-_'']', '', 'g'), 'ß', chr(1))")


def sql_similarity(a: str, b: str) -> str:
    return (f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0"
            f" ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END")


def sql_date(x: str) -> str:
    s = f"trim({x})"
    cases = []
    for fmt, shape in (
        ("%d/%m/%Y", "\\d{1,2}/\\d{1,2}/\\d{4}"),
        ("%d-%m-%Y", "\\d{1,2}-\\d{1,2}-\\d{4}"),
        ("%d.%m.%Y", "\\d{1,2}\\.\\d{1,2}\\.\\d{4}"),
        ("%d%m%Y", "\\d{8}"),
        ("%Y/%m/%d", "\\d{4}/\\d{1,2}/\\d{1,2}"),
        ("%Y-%m-%d", "\\d{4}-\\d{1,2}-\\d{1,2}"),
        ("%Y.%m.%d", "\\d{4}\\.\\d{1,2}\\.\\d{1,2}"),
        ("%Y%m%d", "\\d{8}"),
    ):
        cases.append(f"CASE WHEN regexp_full_match({s}, '{shape}') THEN try_strptime({s}, '{fmt}') END")
    return f"CAST(coalesce({', '.join(cases)}) AS DATE)"
