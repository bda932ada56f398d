"""Operators against plain windows and hand-made cases, with skewed groups."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from fieldglass import constants as K
from fieldglass.functions.labels import RESULT_TYPE
from fieldglass.operators import evaluation as E
from fieldglass.operators import events as V
from fieldglass.operators import logs as L
from fieldglass.operators import messages as M
from fieldglass.operators import pages as P
from fieldglass.operators import prompts as R
from fieldglass.operators import quota as Q
from fieldglass.operators import reports, slices, tenancy
from fieldglass.operators import workflows as W


def t(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; nulls in the key and the value, tied times."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 97 == 0 else f"k{rng.randrange(40)}")
        value = None if rng.random() < 0.1 else rng.choice(["a", "b", "c"])
        rows.append((i, key, t(rng.randrange(4000) / 2), value, rng.random() * 100 - 20))
    return spark.createDataFrame(rows, "id int, k string, ts timestamp, v string, x double").cache()


def test_ordinal_equals_row_number(skewed):
    got = slices.ordinal_in_group(skewed, ["k"], [F.col("ts"), F.col("id")], F.date_trunc("minute", "ts"))
    plain = skewed.withColumn("ordinal", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")))
    assert {(r.id, r.ordinal) for r in got.collect()} == {(r.id, r.ordinal) for r in plain.collect()}


def test_lag_equals_lag(skewed):
    got = slices.lag_in_group(skewed, ["k"], ["ts", "id"], F.date_trunc("minute", "ts"), "v")
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = skewed.withColumn("previous", F.lag("v").over(w)).withColumn("has_previous", F.row_number().over(w) > 1)
    keep = lambda df: {(r.id, r.previous, r.has_previous) for r in df.collect()}
    assert keep(got) == keep(plain)


@pytest.mark.parametrize("size", [7, 5000])
def test_chunks_concatenate_to_the_whole_list(skewed, size):
    got = slices.chunked_lists(skewed, ["k"], [F.col("ts"), F.col("id")], F.date_trunc("minute", "ts"), F.col("id"), "ids", size)
    lists: dict = {}
    for r in sorted(got.collect(), key=lambda r: (str(r.k), r.chunk)):
        assert len(r.ids) <= size
        lists.setdefault(r.k, []).extend(r.ids)
    rows = sorted(skewed.collect(), key=lambda r: (r.ts, r.id))
    want: dict = {}
    for r in rows:
        want.setdefault(r.k, []).append(r.id)
    assert lists == want


def test_exact_median(skewed):
    got = {r.k: r.median for r in slices.exact_median(skewed, ["k"], "x").collect()}
    want: dict = {}
    for r in skewed.collect():
        want.setdefault(r.k, []).append(r.x)
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in want.items()}


def test_exact_median_repeats_and_negatives(spark):
    df = spark.createDataFrame(
        [("a", float(x)) for x in [1, 1, 1, 2]] + [("b", -5.0), ("b", 7.0)] + [("c", 3.0), ("d", None)], "k string, x double")
    got = {r.k: r.median for r in slices.exact_median(df, ["k"], "x").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 3.0}


def events(spark, rows):
    cols = "id bigint, execution_id string, workflow_id string, organization_id int, created_at timestamp, event_type string, error_type string"
    return spark.createDataFrame([(i, x, "wf", 1, t(s), kind, err) for i, x, s, kind, err in rows], cols)


@pytest.fixture(scope="module")
def log(spark):
    return events(spark, [
        (1, "done", 0, K.STARTED, None), (2, "done", 5, K.COMPLETED, None),
        (3, "open", 0, K.STARTED, None),
        (4, "retry", 0, K.STARTED, None), (5, "retry", 1, K.STARTED, None), (6, "retry", 9, K.FAILED, K.RETRYABLE_ERROR),
        (7, "fatal", 0, K.STARTED, None), (8, "fatal", 3, K.FAILED, "ValueError"),
        (9, "step", 0, K.STARTED, None), (10, "step", 4, K.STEP_COMPLETED, None),
        (11, "orphan", 0, K.FAILED, K.RETRYABLE_ERROR),
        (12, "tie", 0, K.STARTED, None), (13, "tie", 0, K.COMPLETED, None),
    ])


def test_resumable(log):
    latest = {r.execution_id: r.id for r in V.resumable_executions(log).collect()}
    assert latest == {"open": 3, "retry": 4}
    oldest = {r.execution_id: r.id for r in V.resumable_executions(log, "reference").collect()}
    assert oldest == {"done": 1, "open": 3, "retry": 4, "fatal": 7, "step": 9, "tie": 12}


def test_last_event(log):
    assert {r.execution_id: r.id for r in V.last_event(log).collect()} == {
        "done": 2, "open": 3, "retry": 6, "fatal": 8, "step": 10, "orphan": 11, "tie": 13}


def test_page_limits(log):
    assert [r.id for r in V.events_page(log, 2, 3).collect()] == [7, 9]
    assert V.events_page(log, 0).count() == 13 and V.events_page(log, None, 12).count() == 1


def test_await_result_bounds(spark):
    df = events(spark, [
        (1, "at-deadline", 29, K.STARTED, None), (2, "at-deadline", 59, K.COMPLETED, None),
        (3, "late", 0, K.STARTED, None), (4, "late", 30.000001, K.COMPLETED, None),
        (5, "same-instant", 10, K.STARTED, None), (6, "same-instant", 10, K.FAILED, "E"),
        (7, "before", 10, K.COMPLETED, None), (8, "before", 11, K.STARTED, None),
        (9, "two", 0, K.STARTED, None), (10, "two", 1, K.STEP_COMPLETED, None), (11, "two", 2, K.COMPLETED, None),
        (12, "again", 0, K.STARTED, None), (13, "again", 25, K.STARTED, None), (14, "again", 35, K.COMPLETED, None),
    ])
    got = {r.start_id: (r.status, r.result_id, r.code) for r in V.await_result(df).collect()}
    assert got == {
        1: ("SUCCESS", 2, 200), 3: ("TIMEOUT", None, 408), 5: ("FAILED", 6, 200), 8: ("TIMEOUT", None, 408),
        9: ("UNSUPPORTED", 10, 400), 12: ("TIMEOUT", None, 408), 13: ("SUCCESS", 14, 200)}


def test_await_result_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"x{rng.randrange(6)}", rng.randrange(3000) / 10,
             rng.choice([K.STARTED, K.COMPLETED, K.FAILED]), None) for i in range(400)]
    got = {r.start_id: r.result_id for r in V.await_result(events(spark, rows), timeout_s=7).collect()}
    want = {}
    for i, x, s, kind, _ in rows:
        if kind == K.STARTED:
            hits = [(s2, i2) for i2, x2, s2, k2, _ in rows if x2 == x and k2 != K.STARTED and s <= s2 <= s + 7]
            want[i] = min(hits)[1] if hits else None
    assert got == want


def test_status_view_debug(spark):
    payload = '{"total_processing_time_ms":5,"workflow_metadata":[{"step_name":"s","execution_time":1.0}],"final_result":{"classification":{"document_type":"cni","confidence":0.5}}}'
    df = spark.createDataFrame([(1, "x", "wf", 1, t(0), K.COMPLETED, payload), (2, "y", "wf", 1, t(0), "Odd", payload)],
                               "id int, execution_id string, workflow_id string, organization_id int, created_at timestamp, event_type string, event string")
    parsed = V.parse_event_payload(df)
    assert [r.payload_error for r in parsed.orderBy("id").collect()] == [None, "Unsupported event type: Odd"]
    plain = V.status_view(parsed).filter("execution_id = 'x'").first()
    debug = V.status_view(parsed, debug=True).filter("execution_id = 'x'").first()
    assert plain.status == "SUCCESS" and plain.success.workflow_metadata is None
    assert debug.success.workflow_metadata[0].step_name == "s"
    assert debug.success.result.classification.document_type == "cni"


def test_quota_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", t(i * 0.2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, api_key string, ts timestamp")
    got = Q.request_ordinals(df)
    for size, name in (("minute", "minute_count"), ("day", "day_count")):
        w = Window.partitionBy("api_key", F.date_trunc(size, "ts")).orderBy("ts", "id")
        want = {(r.id, r.n) for r in df.withColumn("n", F.row_number().over(w)).collect()}
        assert {(r.id, r[name]) for r in got.collect()} == want
    row = {r.id: r for r in Q.usage_quota(df, per_minute=5, per_day=100).collect()}
    denied = sum(not r.allowed for r in row.values())
    assert denied > 0 and all(r.remaining_minute >= 0 and r.remaining_day >= 0 for r in row.values())


def result(name, text):
    return (([text],), name, "pdf", "textarea", False)


def test_two_metrics_weigh_twice_and_skip_is_excluded(spark):
    schema = ("id bigint, data struct<pdf:string,document_type:string>,"
              f" annotations array<struct<ground_truth:boolean,completed_by:string,result:array<{RESULT_TYPE}>>>,"
              f" predictions array<struct<id:bigint,model_version:string,result:array<{RESULT_TYPE}>>>")

    def task(i, kind, truth, predicted, version="m"):
        return (i, ("p", kind), [(True, None, [result(*r) for r in truth])], [(i * 10, version, [result(*r) for r in predicted])])

    tasks = spark.createDataFrame([
        task(1, "BULLETIN_SALAIRE", [("identite_salarie", "Jean Martin")], [("identite_salarie", "Martin Jean")], None),
        task(2, "avis_imposition", [("montant_impot", "1")], [("montant_impot", "2")]),
        task(3, None, [("type", "cni")], [("nom", "x")]),
        task(4, None, [("nom", "x")], [("nom", "x")]),
        task(5, "autre", [("nom", "x")], [("nom", "x")]),
        (6, ("p", "cni"), [], [(60, "m", [])]), (7, ("p", "cni"), [(True, None, [])], []),
    ], schema)
    obs = {r.task_id: r for r in E.observations(E.pair_predictions(tasks)).collect()}
    # 10 fields, one with two metrics: numbers agree when missing (3), texts too (2), dates do not (4),
    # the token set agrees and the edit similarity is partial
    lev = {(r.field, r.metric): r.score for r in E.field_scores(E.pair_predictions(tasks)).collect() if r.task_id == 1}
    assert lev[("identite_salarie", "token_set_equality")] == 1.0 and len(lev) == 11
    assert obs[1].evaluated_fields == 11 and obs[1].score == pytest.approx(sum(lev.values()) / 11)
    assert obs[1].model_version == "Unknown"
    assert obs[2].evaluated_fields == 10 and obs[2].skipped_fields == 5
    assert obs[3].document_type == "cni" and obs[3].error is None
    assert obs[4].skipped and obs[4].score == 0.0 and "infer" in obs[4].error
    assert not obs[5].skipped and obs[5].error and obs[5].score == 0.0
    counters = E.evaluation_counters(tasks).first()
    assert tuple(counters) == (7, 4, 3)
    assert {r.task_id: r.reason for r in E.skipped_tasks(tasks).collect()} == {6: "no ground truth", 7: "no predictions"}


def test_skip_marks_in_field_means(spark):
    df = spark.createDataFrame([("m", "f", "x", -1.0), ("m", "f", "x", 1.0), ("m", "g", "x", -1.0), ("n", "f", "x", 0.5)],
                               "model_version string, field string, metric string, score double")
    stats = {(r.model_version, r.field): r for r in reports.field_metric_stats(df).collect()}
    assert stats["m", "f"].mean == 0.0 and stats["m", "g"].mean is None and stats["m", "g"]["count"] == 1
    table = {r.field: r for r in reports.field_metric_by_model(df).collect()}
    assert (table["f"].m, table["f"].n, table["g"].m, table["g"].n) == ("0.000", "0.500", "SKIPPED", "SKIPPED")


def test_barcodes_second_pass(spark):
    df = spark.createDataFrame([
        (1, 1, 1, 1, 0, "QR", "a"), (1, 1, 1, 2, 0, "QR", "a"), (1, 1, 2, 1, 0, "QR", "b"),
        (1, 2, 1, 1, 0, "2D_DOC", "x"), (1, 2, 2, 1, 0, "QR", "never"), (1, 3, 2, 1, 0, "AZTEC", "no key"),
    ], "doc_id int, page_number int, pass int, pos int, tie int, type string, raw_data string")
    got = {(r.page_number, r.key, r.pos) for r in P.merged_passes(df).collect()}
    assert got == {(1, "qr:a", 1), (1, "qr:b", 1), (2, "dm:x", 1)}


def test_prompt_chunks(spark):
    df = spark.createDataFrame([("d", i, None if i == 1 else f"p{i}", False) for i in range(7)],
                               "execution_id string, page_number int, text string, has_failed boolean")
    whole = P.assemble_user_prompt(df).first().user_prompt
    parts = [r.user_prompt for r in P.assemble_user_prompt(df, pages_per_chunk=3).orderBy("chunk").collect()]
    assert len(parts) == 3 and "".join(parts) == whole and whole.startswith("p0\n\nNone\n\np2")


def test_prompt_changes_first_and_null(spark):
    df = spark.createDataFrame([(i, " a " if i % 2 else "a", t(i * 1000), p) for i, p in enumerate(["x", "x", None, None, "x"])]
                               + [(9, None, t(0), None)], "id int, document_type string, ts timestamp, prompt string")
    got = sorted(r.id for r in R.prompt_changes(df, F.date_trunc("minute", "ts")).collect())
    assert got == [0, 2, 4, 9]


def test_label_mapping_rules(spark):
    df = spark.createDataFrame([
        (1, "Année des revenus", "2023", 0), (1, " Revenu fiscal de référence ", "1 200,5", 1), (1, "Déclarant 1", "A", 2),
        (1, "Déclarant 1", "B", 3), (1, "Montant de l’impôt", "n/a", 4), (1, "Inconnu", "z", 5),
        (2, "Année des revenus", "2023", 0),
    ], "doc_id int, label string, value string, pos int")
    got = {r.doc_id: r.fields for r in P.map_labels_to_fields(df).collect()}
    assert got == {1: {"Année des revenus": "2023", "Revenu fiscal de référence": "1200.5", "Nom du déclarant 1": "B"}}


def test_reclaim_modes(spark):
    df = spark.createDataFrame([(1, "d", 0, t(0)), (2, "d", 3, t(0)), (3, "d", 0, t(999)), (4, "d", None, t(0))],
                               "msg_id int, data string, retries int, delivered_at timestamp")
    acks = spark.createDataFrame([(4,)], "msg_id int")
    now = F.lit(t(1000))
    fixed = {r.msg_id: (r.route, r.next_retries, r.acknowledged) for r in M.reclaim_idle(df, acks, now).collect()}
    ref = {r.msg_id: (r.route, r.next_retries, r.acknowledged) for r in M.reclaim_idle(df, acks, now, mode="reference").collect()}
    assert fixed == {1: ("requeue", 1, True), 2: ("dlq", None, True)}
    assert ref == {1: ("requeue", 2, True), 2: ("dlq", None, False)}


def test_trim_pushes_the_limit_below_the_shuffle(spark):
    df = spark.createDataFrame([(i, t(i), f"s{i % 2}") for i in range(50)], "msg_id int, delivered_at timestamp, s string")
    kept = M.trim_stream(df, 3, ("s",))
    assert {r.msg_id for r in kept.collect()} == {49, 48, 47, 46, 45, 44}
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_retention_keeps_undue_rows(spark):
    rows = [(1, K.STARTED, t(0), "PENDING", "f"), (2, K.STARTED, t(0), "DONE", "f"), (3, K.STARTED, t(999), None, "f"),
            (4, K.FAILED, t(0), None, "f")]
    df = spark.createDataFrame(rows, "id int, event_type string, created_at timestamp, anonymization_status string, file_url string")
    got = {r.id: (r.file_url, r.anonymization_status) for r in V.redact_events(df, F.lit(t(10))).collect()}
    assert got == {1: (None, "DONE"), 2: ("f", "DONE"), 3: ("f", "PENDING"), 4: ("f", "DONE")}


def test_not_found_notifications(spark, log):
    hooks = spark.createDataFrame([(7, 1, "u", {"X": "1"})], "id int, organization_id int, url string, headers map<string,string>")
    msgs = spark.createDataFrame([("done", 7), ("done", 8), ("none", 7)], "execution_id string, webhook_id int")
    got = {(r.execution_id, r.webhook_id): (r.event_id, r.error) for r in tenancy.resolve_notifications(msgs, hooks, log).collect()}
    assert got == {("done", 7): (2, None), ("done", 8): (2, "WebHook not found: 8"), ("none", 7): (None, "Event not found: none")}


def test_workflow_first_definition_and_empty_steps(spark):
    df = spark.createDataFrame([("a", ["x"], 2), ("a", ["download_file", "nope"], 1)], "id string, steps array<string>, position int")
    first = W.first_by_position(df)
    assert [r.steps for r in first.collect()] == [["download_file", "nope"]]
    assert W.runnable_workflows(first).first().steps == ["download_file"]
    assert W.runnable_workflows(df.filter("position = 2").drop("position")).first().error == "No workflow steps found"


def test_execution_log_failure(spark):
    rows = [Row(id=1, execution_id="x", workflow_id="w", created_at=t(0), event_type=K.STARTED, error_type=None, step_name="a", retry_count=None),
            Row(id=2, execution_id="x", workflow_id="w", created_at=t(1.5), event_type=K.FAILED, error_type="E", step_name=None, retry_count=2)]
    cols = ("id int, execution_id string, workflow_id string, created_at timestamp, event_type string, error_type string,"
            " step_name string, retry_count int")
    df = spark.createDataFrame([tuple(r) for r in rows], cols)
    r = L.execution_log(df).first()
    assert (r.status, r.elapsed_time_ms, r.error_type, r.failed_step, r.retry_count, r.log_lines) == ("failed", 1500, "E", "unknown", 2, 2)
    lines = L.execution_log_lines(df, F.date_trunc("hour", "created_at")).orderBy("position").collect()
    assert [(x.position, x.event_type) for x in lines] == [(1, K.STARTED), (2, K.FAILED)]
