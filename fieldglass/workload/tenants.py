"""Organizations, keys, webhooks, workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import delivery as D
from ..functions.protect import merge_headers
from ..operators import tenancy as T
from ..operators import workflows as W
from ..operators.events import page
from .registry import query
from .views import Inputs


@query("keys_with_org", sql="""
SELECT k.id, k.prefix, k.status, o.name AS organization_name, o.platform_role
FROM api_keys k LEFT JOIN organizations o ON o.id = k.organization_id""")
def keys_with_org(v: Inputs) -> DataFrame:
    return T.keys_with_organization(v.api_keys, v.organizations).select(
        "id", "prefix", "status", "organization_name", "platform_role")


@query("org_with_keys", sql="""
SELECT o.id, o.name, CAST(coalesce((k.rn - 1) // 2, 0) AS INT) AS chunk,
  coalesce(string_agg(k.prefix || ':' || k.status, ',' ORDER BY k.id), '') AS keys
FROM organizations o LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY id) AS rn FROM api_keys) k
  ON k.organization_id = o.id GROUP BY 1, 2, 3""")
def org_with_keys(v: Inputs) -> DataFrame:
    out = T.organization_with_keys(v.organizations, v.api_keys, F.floor(F.col("id") / 4), chunk_rows=2)
    names = F.transform("api_keys", lambda k: F.concat_ws(":", k["prefix"], k["status"]))
    return out.select("id", "name", "chunk", F.coalesce(F.array_join(names, ","), F.lit("")).alias("keys"))


@query("active_keys", sql="SELECT id, prefix, organization_id FROM api_keys WHERE status = 'Active'")
def active_keys(v: Inputs) -> DataFrame:
    return T.active_key_by_prefix(v.api_keys).select("id", "prefix", "organization_id")


@query("active_key_lookup", sql="SELECT id, prefix FROM api_keys WHERE status = 'Active' AND prefix = 'NATION_6'")
def active_key_lookup(v: Inputs) -> DataFrame:
    return T.active_key_by_prefix(v.api_keys, "NATION_6").select("id", "prefix")


@query("organization_webhooks", sql="SELECT id, url FROM webhooks WHERE organization_id = 3")
def organization_webhooks(v: Inputs) -> DataFrame:
    return T.by_organization(v.webhooks, 3).select("id", "url")


@query("platform_admins", sql="""
SELECT k.id, k.prefix FROM api_keys k JOIN organizations o ON o.id = k.organization_id
WHERE o.platform_role = 'PlatformAdmin'""")
def platform_admins(v: Inputs) -> DataFrame:
    return T.platform_admins(T.keys_with_organization(v.api_keys, v.organizations)).select("id", "prefix")


@query("key_listing", sql="SELECT id, prefix FROM api_keys ORDER BY id LIMIT 10 OFFSET 5")
def key_listing(v: Inputs) -> DataFrame:
    return page(v.api_keys, [F.col("id").asc()], 10, 5).select("id", "prefix")


@query("key_prefixes", sql="""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ABCDEFG' || CAST(2 + c_custkey % 6 AS VARCHAR) END AS prefix FROM customer""")
def key_prefixes(v: Inputs) -> DataFrame:
    key = F.col("c_custkey")
    body = F.repeat(F.lit("A2B3"), 12)
    prefix = F.concat(F.lit("ABCDEFG"), (2 + key % 6).cast("string"))
    presented = (
        F.when(key % 3 == 0, F.concat(F.lit("dia_prod_v1_"), prefix, F.lit("_"), body, F.lit("_ABCD")))
        .when(key % 3 == 1, F.concat(F.lit("dia_local_v1_"), prefix, F.lit("_"), body, F.lit("_ABCD")))
        .otherwise(F.col("c_name"))
    )
    return v.customer.select(key.alias("id"), D.key_prefix(presented).alias("prefix"))


def finished(v: Inputs) -> DataFrame:
    """Finished executions as the pipeline reports them."""
    ended = v.event_store.filter(
        F.col("event_type").isin("WorkflowExecutionCompleted", "WorkflowExecutionFailed"))
    return ended.select("id", "execution_id", "organization_id", "error_type",
                        (F.col("retry_count") >= 2).alias("is_last_retry"))


FANOUT_SQL = """
SELECT e.id, e.execution_id, w.id AS webhook_id, w.url FROM event_store e JOIN webhooks w ON w.organization_id = e.organization_id
WHERE e.event_type IN ('WorkflowExecutionCompleted', 'WorkflowExecutionFailed')
  AND NOT (coalesce(e.error_type, '') = 'RetryableException' AND e.retry_count < 2)"""


@query("webhook_fanout", sql=FANOUT_SQL)
def webhook_fanout(v: Inputs) -> DataFrame:
    out = T.webhook_fanout(T.finished_to_notify(finished(v)), v.webhooks)
    return out.select("id", "execution_id", "webhook_id", "url")


@query("resolve_notifications", sql="""
WITH m AS (SELECT msg_id, CASE WHEN msg_id % 9 = 0 THEN 'gone-' || msg_id ELSE
  CAST(e.user_id AS VARCHAR) || '-' || CAST(CAST(e.ts AS DATE) AS VARCHAR) END AS execution_id,
  CASE WHEN msg_id % 10 = 0 THEN -1 ELSE 1 + msg_id % 10 END AS webhook_id
  FROM messages JOIN events e ON e.event_id = msg_id),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, id DESC) AS rn FROM event_store) WHERE rn = 1)
SELECT m.msg_id, w.url, l.id AS event_id,
  CASE WHEN w.id IS NULL THEN 'WebHook not found: ' || m.webhook_id WHEN l.id IS NULL THEN 'Event not found: ' || m.execution_id END AS error
FROM m LEFT JOIN webhooks w ON w.id = m.webhook_id LEFT JOIN l ON l.execution_id = m.execution_id""")
def resolve_notifications(v: Inputs) -> DataFrame:
    number = F.col("event_id")
    messages = v.events.select(
        number.alias("msg_id"),
        F.when(number % 9 == 0, F.concat(F.lit("gone-"), number.cast("string"))).otherwise(
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
        ).alias("execution_id"),
        F.when(number % 10 == 0, -1).otherwise(1 + number % 10).cast("bigint").alias("webhook_id"),
    )
    out = T.resolve_notifications(messages, v.webhooks, v.event_store)
    return out.select("msg_id", "url", "event_id", "error")


@query("merged_headers", sql="""
SELECT id, 'application/json' AS content_type, 'hook-' || id AS token FROM webhooks""")
def merged_headers(v: Inputs) -> DataFrame:
    custom = F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("X-Token"),
                          F.concat(F.lit("hook-"), F.col("id").cast("string")))
    out = v.webhooks.select("id", merge_headers(custom).alias("h"))
    return out.select("id", F.col("h")["Content-Type"].alias("content_type"), F.col("h")["X-Token"].alias("token"))


_STEPS = """s AS (SELECT id AS workflow_id, unnest(string_split(steps, ',')) AS step,
  CAST(generate_subscripts(string_split(steps, ','), 1) - 1 AS INT) AS position FROM workflow_rows)"""


@query("workflow_steps", sql=f"""WITH {_STEPS},
e AS (SELECT workflow_id, count(*) AS executions FROM event_store GROUP BY 1)
SELECT s.workflow_id, s.position, s.step, e.executions FROM s JOIN e ON e.workflow_id = s.workflow_id WHERE s.step <> 'unknown_step'""")
def workflow_steps(v: Inputs) -> DataFrame:
    known, _ = W.resolve_steps(v.workflows)
    runs = v.event_store.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("executions"))
    return known.join(runs, "workflow_id").select("workflow_id", "position", "step", "executions")


@query("unknown_steps", sql=f"""WITH {_STEPS},
e AS (SELECT workflow_id, count(*) AS executions FROM event_store GROUP BY 1)
SELECT s.workflow_id, s.step, e.executions FROM s JOIN e ON e.workflow_id = s.workflow_id WHERE s.step = 'unknown_step'""")
def unknown_steps(v: Inputs) -> DataFrame:
    _, unknown = W.resolve_steps(v.workflows)
    runs = v.event_store.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("executions"))
    return unknown.join(runs, "workflow_id").select("workflow_id", "step", "executions")


@query("effective_parameters", sql="""
SELECT e.id, CASE WHEN e.id % 3 = 0 THEN 'mistral-medium-2508' ELSE w.llm_model END AS effective_model,
  e.id % 4 = 0 AS classification_skipped, CASE WHEN e.id % 4 = 0 THEN 1.0::DOUBLE END AS confidence,
  CASE WHEN e.id % 4 = 0 THEN 'cni' WHEN e.id % 4 = 1 THEN 'passeport,cni'
    ELSE 'cni,passeport,permis_conduire,avis_imposition,bulletin_salaire,visale_certificate' END AS effective_types
FROM event_store e JOIN workflow_rows w ON w.id = e.workflow_id""")
def effective_parameters(v: Inputs) -> DataFrame:
    asked = v.event_store.select(
        "id", "workflow_id",
        F.when(F.col("id") % 3 == 0, "mistral-medium-2508").alias("requested_model"),
        F.when(F.col("id") % 4 == 0, "cni").alias("requested_type"),
        F.when(F.col("id") % 4 == 1, F.array(F.lit("passeport"), F.lit("cni"))).alias("candidate_types"),
    )
    out = W.effective_parameters(asked, v.workflows)
    return out.select("id", "effective_model", "classification_skipped", "confidence",
                      F.array_join("effective_types", ",").alias("effective_types"))


@query("supported_types", sql="SELECT task_id, document_type FROM task_flags WHERE document_type <> 'autre'")
def supported_types(v: Inputs) -> DataFrame:
    return W.supported_types(v.task_flags).select("task_id", "document_type")


@query("first_workflow_definition", sql="""
SELECT workflow_id AS id, arg_min(step_name, event_store.id) AS first_step FROM event_store GROUP BY 1""")
def first_workflow_definition(v: Inputs) -> DataFrame:
    defined = v.event_store.select(F.col("workflow_id").alias("id"), F.col("step_name").alias("first_step"),
                                   F.col("id").alias("position"))
    return W.first_by_position(defined)


@query("organization_key_items", sql="""
SELECT o.id, o.name, coalesce(count(k.id) OVER (PARTITION BY o.id), 0) AS items, k.prefix, k.status,
  CASE WHEN k.id IS NOT NULL THEN row_number() OVER (PARTITION BY o.id ORDER BY k.id) END AS position
FROM organizations o LEFT JOIN api_keys k ON k.organization_id = o.id""")
def organization_key_items(v: Inputs) -> DataFrame:
    header, items = T.organization_key_items(v.organizations, v.api_keys, F.floor(F.col("id") / 4))
    keys = items.select(F.col("organization_id").alias("org"), "prefix", "status", "position")
    return header.join(keys, header["id"] == keys["org"], "left").select("id", "name", "items", "prefix", "status", "position")
