"""Registry, user code, sources and sinks, composite jobs."""

import json
import os
import tempfile
import types
import warnings

import pytest
from pyspark.sql import functions as F

import fieldglass.metrics as builtin
from fieldglass import constants as K
from fieldglass import schemas as S_
from fieldglass.catalog import field_catalog
from fieldglass.operators import custom as C
from fieldglass.operators import evaluation as E
from fieldglass.operators import files as O
from fieldglass.operators.slices import join_children
from fieldglass.operators.registry import MetricRegistry, discover, prepare_inputs, registry
from fieldglass.plans import jobs
from fieldglass.sources import sinks as S
from fieldglass.sources import tables as T
from fieldglass.workload.views import Inputs

from compare import DATA


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_registry_order_and_fallback(spark):
    r = MetricRegistry()
    df = spark.range(1)
    r.renderer("m")(lambda obs: obs.withColumn("x", F.lit(1)))
    assert r.get_metric("m").build is None and r.has_renderer("m")
    with pytest.raises(ValueError):
        r.evaluate("m", df)
    r.register("m", "d", require=("prediction",))(lambda inputs: inputs)
    r.register("n", "d")(lambda inputs: inputs)
    assert r.get_metric_names() == ["m", "n"] and set(r.list_metrics()) == {"m", "n"}
    assert r.render("m", df).columns == ["id", "x"] and r.render("n", df) is df
    assert r.get_metric("zzz") is None and not r.has_renderer("n")


def test_prepare_inputs(spark):
    pairs = E.pair_predictions(Inputs(spark, DATA).label_tasks)
    got = prepare_inputs(pairs, ("prediction", "ground_truth", "output", "query"))
    assert got.columns == ["task_id", "model_version", "prediction_id", "processing_time_ms", "prediction", "ground_truth", "output"]


def test_discovery_warns_about_broken_modules():
    assert discover(builtin) == ["field_by_field"] and registry.get_metric(K.FIELD_METRIC_NAME).build
    path = folder()
    write(f"{path}/broken.py", "raise RuntimeError('no')")
    write(f"{path}/_private.py", "raise RuntimeError('never')")
    plug = types.ModuleType("plug")
    plug.__path__ = [path]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert discover(plug) == []
    assert any("broken" in str(w.message) for w in seen)


def test_report_bundle(spark):
    out = jobs.report_by_model(Inputs(spark, DATA).label_tasks, ["model-a", "model-b"])
    assert set(out) == {"field_metric_by_model", "model_summary", "processing_time_stats", "field_metric_stats", "error_observations"}
    assert out["field_metric_by_model"].count() == 9 and out["model_summary"].count() == 2


def test_experiment_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    rows = [(k % 4 or None, k, f"m{k % 2}", k / 10 if k % 3 else None, 5.0, "{}") for k in range(40)]
    frame = spark.createDataFrame(rows, "task_id long, prediction_id long, model_version string, raw double, processing_time_ms double, observation string")
    path = folder()
    S.save_experiment(frame.withColumn("score", watched("raw")), path, "e", 1, "m")
    assert seen.value == 40
    row = T.scan_experiments(spark, f"{path}/experiments").first()
    known = [r[3] for r in rows if r[3] is not None]
    assert (row.processed_count, row.total_tasks) == (3, 3) and row.average_score == pytest.approx(sum(known) / len(known))
    assert json.loads(row.model_version_stats)["m0"]["sample_count"] == 20
    assert T.scan_observations(spark, f"{path}/observations").count() == 40
    S.save_experiment(frame.limit(0).withColumn("score", F.col("raw")), path, "none", 1, "m", total_tasks=9)
    row = T.scan_experiments(spark, f"{path}/experiments").filter("id = 'none'").first()
    assert (row.processed_count, row.total_tasks, row.average_score, row.model_version_stats) == (0, 9, None, None)


def test_bucketed_tables_join_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        root = folder()
        S.write_bucketed(spark.range(200).withColumnRenamed("id", "task_id"), "truths_t", f"{root}/a", buckets=4)
        S.write_bucketed(spark.range(300).select((F.col("id") % 150).alias("task_id"), "id"), "predictions_t", f"{root}/b", buckets=4)
        pairs = E.join_split_tables(spark.table("predictions_t"), spark.table("truths_t"))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert pairs.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("truths_t", "predictions_t"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_report_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def watched(x):
        seen.add(1)
        return x

    tasks = Inputs(spark, DATA).label_tasks
    n = tasks.count()
    out = jobs.report_by_model(tasks.withColumn("id", watched("id")))
    for table in out.values():
        table.collect()
    assert 0 < seen.value <= n


def test_rejected_replays(spark):
    path = folder()
    write(f"{path}/r.json", '{"execution_id":"a","document_type":"d","model":"m","system_prompt":"s","user_prompt":"u"}\n{oops\n{"execution_id":"b","model":"m"}\n')
    good, bad = T.split_replay_payloads(spark, path)
    assert [r.execution_id for r in good.collect()] == ["a"]
    assert {(r.execution_id, r.record, r.reason, r.file) for r in bad.collect()} == {
        (None, "{oops", "unreadable", "r.json"), ("b", None, "missing document_type, system_prompt, user_prompt", "r.json")}
    assert T.scan_replay_payloads(spark, path).count() == 1


def test_custom_metric_errors_become_observations(spark):
    pairs = E.pair_predictions(Inputs(spark, DATA).label_tasks).limit(5)

    def boom(prediction, truth, document_type):
        raise KeyError("x")

    rows = C.evaluate_custom(pairs, boom).collect()
    assert len(rows) == 5 and all(r.failed and r.score == 0.0 and "error" in json.loads(r.observation) for r in rows)


def test_catalog(spark):
    rows = field_catalog(spark).collect()
    assert len(rows) == 55 and all(r.metrics for r in rows)
    assert {r.document_type for r in rows} == set(K.DOCUMENT_TYPES) - {K.OTHER_TYPE}


def test_workflow_catalog(spark):
    path = f"{folder()}/w.json"
    full = {"id": "a", "name": "n", "description": "d", "version": "1", "enabled": True, "supported_file_types": ["x"],
            "steps": ["download_file"], "llm_model": "albert-large", "max_file_size_mb": 1, "processing_timeout_minutes": 2,
            "created_at": "c", "updated_at": "u"}
    write(path, json.dumps([full, {"id": "broken"}, {**full, "id": "b"}]))
    good, bad = T.scan_workflow_catalog(spark, path)
    assert [r.id for r in good.orderBy("position").collect()] == ["a", "b"] and bad.count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        T.scan_workflow_catalog(spark, path + ".none")


def test_small_scans(spark):
    root = folder()
    write(f"{root}/ids.csv", "other,file_id\n1, a \n2,\n3,  \n4,b\n")
    assert [r.file_id for r in T.scan_file_ids_csv(spark, f"{root}/ids.csv").collect()] == ["a", "b"]
    write(f"{root}/ocr/x.json", json.dumps({"pages": [{"page_number": 1, "text": "t", "has_failed": False}, {"page_number": 2}]}))
    assert [(r.page_number, r.text) for r in T.scan_ocr_pages(spark, f"{root}/ocr").collect()] == [(1, "t"), (2, None)]
    ok = {"execution_id": "e", "document_type": "cni", "model": "m", "system_prompt": "s", "user_prompt": "u"}
    write(f"{root}/replay/a.json", json.dumps(ok))
    write(f"{root}/replay/b.json", "{bad")
    write(f"{root}/replay/c.json", json.dumps({"execution_id": "x"}))
    assert [r.execution_id for r in T.scan_replay_payloads(spark, f"{root}/replay").collect()] == ["e"]


def test_binary_files(spark):
    root = folder()
    for name, head in {"a.pdf": b"%PDF-1.7", "b.png": b"\x89PNG\r\n\x1a\n", "c.png": b"nope"}.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(head)
    files = T.scan_documents_binary(spark, root)
    checks = {r.filename: r.check.is_valid for r in O.validate_binary_files(files).collect()}
    assert checks == {"a.pdf": True, "b.png": True, "c.png": False}
    inventory = O.object_inventory(files)
    assert sorted(r.content_type for r in inventory.collect()) == ["application/pdf", "image/png", "image/png"]
    assert "content" not in inventory._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1].replace("content_type", "")


def test_event_defaults(spark):
    df = spark.createDataFrame([("w", "x", "o")], "workflow_id string, execution_id string, organization_id string")
    row = S.started_events(df).first()
    event = json.loads(row.event)
    assert event["metadata"] == "{}" and event["version"] == 1 and event["classification_parameters"] == {}
    assert row.id and row.created_at and row.anonymization_status == "PENDING"
    done = S.completed_events(df.selectExpr("*", "'{}' final_result", "5L total_processing_time_ms", "2 steps_completed")).first()
    assert json.loads(done.event)["output_summary"] == "{}"


def test_old_events_read_as_pending_and_retention_touches_due_days_only(spark):
    root = folder()
    rows = [(str(i), "w", f"x{i}", "o", f"2024-01-0{1 + i % 3} 10:00:00", K.STARTED, '{"file_url":"u"}' if i else "{bad") for i in range(6)]
    cols = "id string, workflow_id string, execution_id string, organization_id string, created_at string, event_type string, event string"
    old = spark.createDataFrame(rows, cols).withColumn("created_at", F.to_timestamp("created_at"))
    S.append_events(old, f"{root}/log")
    assert {r.anonymization_status for r in T.scan_event_store(spark, f"{root}/log").collect()} == {"PENDING"}
    newest = f"{root}/log/event_date=2024-01-03"
    before = sorted(os.listdir(newest))
    jobs.retention(spark, f"{root}/log", F.lit("2024-01-09 12:00:00").cast("timestamp"))
    got = {r.id: (r.anonymization_status, r.event) for r in T.scan_event_store(spark, f"{root}/log").collect()}
    assert got["0"] == ("ERROR", "{bad") and got["1"] == ("DONE", '{"file_url":{}}') and got["2"][0] == "PENDING"
    assert len(got) == 6 and sorted(os.listdir(newest)) == before


def test_dataset_layout(spark):
    root = folder()
    S.write_dataset(Inputs(spark, DATA).label_tasks, root)
    back = T.scan_label_tasks(spark, f"{root}/tasks")
    assert E.evaluation_counters(back).collect() == E.evaluation_counters(Inputs(spark, DATA).label_tasks).collect()


def test_prompt_history_folders(spark):
    root = folder()
    df = spark.createDataFrame([("a/b", "p"), (None, "q")], "document_type string, prompt string")
    S.write_prompt_history(df, root)
    assert sorted(x for x in os.listdir(root) if "=" in x) == ["document_type_key=a_b", "document_type_key=unknown"]


def test_tenancy_and_run_tables_read_back(spark):
    root = folder()
    for scan, schema in ((T.scan_organizations, S_.ORGANIZATIONS), (T.scan_api_keys, S_.API_KEYS),
                         (T.scan_webhooks, S_.WEBHOOKS), (T.scan_experiments, S_.EXPERIMENTS),
                         (T.scan_observations, S_.OBSERVATIONS)):
        path = f"{root}/{scan.__name__}"
        spark.createDataFrame([], schema).write.parquet(path)
        assert scan(spark, path).columns == spark.createDataFrame([], schema).columns


def test_own_catalog(spark):
    catalog = spark.createDataFrame([("cni", "nom", "string", ["equality", "levenshtein_distance"])],
                                    "document_type string, field string, declared_type string, metrics array<string>")
    pairs = E.pair_predictions(Inputs(spark, DATA).label_tasks)
    got = E.field_scores(pairs, catalog).select("field", "metric").distinct().collect()
    assert sorted(map(tuple, got)) == [("nom", "equality"), ("nom", "levenshtein_distance")]


def test_join_children_keeps_parents_without_children(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    children = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z"), (None, "n")], "pid int, v string")
    got = sorted(map(tuple, join_children(parents, children, "id", "pid").collect()))
    assert got == [(1, "a", "x"), (1, "a", "y"), (2, "b", None), (3, "c", None)]


def test_split_truth_and_predictions(spark):
    pairs = E.pair_predictions(Inputs(spark, DATA).label_tasks)
    truths = pairs.select("task_id", "truth").dropDuplicates(["task_id"])
    joined = E.join_split_tables(pairs.drop("truth"), truths).select(*pairs.columns)
    score = lambda df: sorted((r.prediction_id, r.score) for r in E.observations(df).collect())
    assert score(joined) == score(pairs)
