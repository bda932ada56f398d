"""Streams fed by several files, so that state and carried tables are exercised."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass import constants as K
from fieldglass.sources.streams import read_message_stream
from fieldglass.streaming import pipeline as SP
from fieldglass.streaming import quota as SQ
from fieldglass.streaming import routing as SR
from fieldglass.streaming import state as SS
from fieldglass.streaming.replay import batch_writer, run_available


def t(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def files(spark, rows, schema, parts=4):
    """Rows as ``parts`` parquet files, written one after the other."""
    path = folder()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return path


REQUESTS = "id int, api_key string, ts timestamp"


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", t(i * 7)) for i in range(600)]
    return rows, files(spark, rows, REQUESTS)


def test_verdicts_carry_over_batches(spark, requests):
    rows, path = requests
    out = folder()
    stream = read_message_stream(spark, path, REQUESTS, "parquet", slots=1)
    run_available(stream, each=SQ.verdict_batch(out, 4, 50))
    got = spark.read.parquet(f"{out}/verdicts")
    assert got.select("batch_id").distinct().count() == 4
    df = spark.createDataFrame(rows, REQUESTS)
    for size, name in (("minute", "minute_count"), ("day", "day_count")):
        w = Window.partitionBy("api_key", F.date_trunc(size, "ts")).orderBy("ts", "id")
        want = {(r.id, r.n) for r in df.withColumn("n", F.row_number().over(w)).collect()}
        assert {(r.id, r[name]) for r in got.collect()} == want


def test_repeated_batch_gives_the_same_verdicts(spark, requests):
    rows, _ = requests
    out = folder()
    write = SQ.verdict_batch(out, 4, 50)
    first, second = (spark.createDataFrame(x, REQUESTS) for x in (rows[:300], rows[300:]))
    write(first, 0)
    write(second, 1)
    before = sorted(map(tuple, spark.read.parquet(f"{out}/verdicts").select("id", "day_count").collect()))
    write(second, 1)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/verdicts").select("id", "day_count").collect())) == before


def test_counters_expire_by_quorum_and_late_requests_are_rejected(spark):
    day = 86_400
    out = folder()
    write = SQ.verdict_batch(out, 1000, 1000, quorum=5)
    batches = [
        [(i, "a", t(100 + i)) for i in range(8)] + [(100, "b", t(90 * day))],  # one request far ahead
        [(i, "a", t(200 + i)) for i in range(10, 14)] + [(101, "b", t(5))],
        [(i, "a", t(2 * day + i)) for i in range(20, 26)],  # five and more move the watermark
        [(30, "a", t(300)), (31, "a", t(2 * day + 60)), (32, "b", t(90 * day + 1))],
    ]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, REQUESTS), n)
    got = {r.id: r.day_count for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert [got[i] for i in (*range(8), *range(10, 14))] == list(range(1, 13))  # nothing was wiped
    assert (got[100], got[101], got[25], got[31], got[32]) == (1, 1, 6, 7, 2)
    rejected = [(r.id, r.reason) for r in spark.read.parquet(f"{out}/rejected").collect()]
    assert rejected == [(30, "day_expired")] and 30 not in got
    counters = spark.read.parquet(f"{out}/counters")
    assert {r.batch_id for r in counters.select("batch_id").distinct().collect()} == {2, 3}
    left = {r.start for r in counters.filter("batch_id = 3 and size = 'day'").collect()}
    assert left == {t(2 * day), t(90 * day)}


def test_window_counts(spark, requests):
    rows, path = requests
    out = folder()
    stream = read_message_stream(spark, path, REQUESTS, "parquet", slots=1)
    run_available(SQ.quota_windows(stream, "1 minute", late="1 day"), mode="update", each=batch_writer(out))
    got = spark.read.parquet(out).groupBy("api_key", "window_start").agg(F.max("requests").alias("n"))
    want = spark.createDataFrame(rows, REQUESTS).groupBy("api_key", F.date_trunc("minute", "ts").alias("w")).count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_trim_over_batches(spark, requests):
    _, path = requests
    out = folder()
    stream = read_message_stream(spark, path, REQUESTS, "parquet", slots=1).select(
        F.col("id").alias("msg_id"), F.col("ts").alias("delivered_at"))
    run_available(stream, each=SR.trim_batch(out, 100))
    latest = spark.read.parquet(f"{out}/version=3")
    assert {r.msg_id for r in latest.collect()} == set(range(500, 600))


def test_decode_split_and_new_files_only(spark, requests):
    _, path = requests
    stream = read_message_stream(spark, path, REQUESTS, "parquet", start_from="$")
    out = folder()
    run_available(stream, path=out)
    assert spark.read.schema(REQUESTS).parquet(out).count() == 0
    df = spark.createDataFrame([(1, '{"k":1}'), (2, "{bad")], "msg_id int, data string")
    good, bad = SR.decode_stream(df, ("k",))
    assert [r.msg_id for r in good.collect()] == [1] and [r.reason for r in bad.collect()] == ["decode_error"]


AWAITED = "id int, execution_id string, created_at timestamp, event_type string"


def test_await_brute_force(spark):
    """Files in disorder within the lateness: every closed start is answered by the stream alone."""
    rng = random.Random(5)
    rows = [(i, f"x{rng.randrange(4)}", t(rng.randrange(20000) / 10), rng.choice([K.STARTED, K.COMPLETED, K.FAILED]))
            for i in range(300)]
    end = max(r[2] for r in rows)
    late = dt.timedelta(seconds=200)
    # a row arrives up to 200 s after its time
    arrival = sorted(rows, key=lambda r: r[2] + rng.random() * late)
    last = [(1000, "other", end + dt.timedelta(seconds=10_000), K.COMPLETED)]
    out = folder()
    stream = read_message_stream(spark, files(spark, arrival + last, AWAITED, 7), AWAITED, "parquet", slots=1)
    query = run_available(SS.await_with_timeout(stream, 20, late_s=200), path=out, settings=SS.ROCKSDB)
    answers, behind = SS.split_late(spark.read.parquet(out))
    got = [(r.start_id, r.result_id) for r in answers.collect()]
    want = {}
    for i, x, s, kind in rows:
        if kind == K.STARTED:
            hits = [(s2, i2) for i2, x2, s2, k2 in rows
                    if x2 == x and k2 != K.STARTED and s <= s2 <= s + dt.timedelta(seconds=20)]
            want[i] = min(hits)[1] if hits else None
    assert len(got) == len(want) and dict(got) == want
    assert behind.count() == 0
    # only the last row is left: in two bands, each with a result, its due time and a timer
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) > 50


def test_await_rows_behind_the_watermark(spark):
    rows = [[(1, "a", t(0), K.STARTED), (2, "b", t(0), K.STARTED)], [(3, "z", t(500), K.COMPLETED)], [(4, "z", t(520), K.COMPLETED)],
            [(5, "a", t(5), K.COMPLETED), (6, "c", t(3), K.STARTED), (7, "d", t(495), K.STARTED), (8, "d", t(496), K.FAILED)],
            [(9, "z", t(900), K.COMPLETED)]]
    path = folder()
    for part in rows:
        spark.createDataFrame(part, AWAITED).coalesce(1).write.mode("append").parquet(path)
    out = folder()
    stream = read_message_stream(spark, path, AWAITED, "parquet", slots=1)
    run_available(SS.await_with_timeout(stream, 20, late_s=10), path=out, settings=SS.ROCKSDB)
    answers, behind = SS.split_late(spark.read.parquet(out))
    got = {r.start_id: (r.status, r.result_id) for r in answers.collect()}
    # 7 and 8 are behind the watermark (510 s), but the wait of 7 is still open then
    assert got == {1: ("TIMEOUT", None), 2: ("TIMEOUT", None), 7: ("FAILED", 8)}
    assert {r.event_id for r in behind.collect()} == {5, 6, 8}


def test_await_keeps_state_per_bucket_of_executions(spark):
    rows = [(i, f"x{i // 2}", t(i % 2 * (i % 40)), K.STARTED if i % 2 == 0 else K.COMPLETED) for i in range(12_000)]
    rows += [(20_000, None, t(0), K.STARTED), (20_001, None, t(3), None), (20_002, "other", t(500), K.FAILED)]
    out = folder()
    stream = read_message_stream(spark, files(spark, rows, AWAITED, 2), AWAITED, "parquet", slots=1)
    query = run_available(SS.await_with_timeout(stream, 20, late_s=40), path=out, settings=SS.ROCKSDB, partitions=4)
    got = {r.start_id: (r.status, r.result_id) for r in SS.split_late(spark.read.parquet(out))[0].collect()}
    want = {i: ("SUCCESS", i + 1) if (i + 1) % 40 <= 20 else ("TIMEOUT", None) for i in range(0, 12_000, 2)}
    assert got == want | {20_000: ("UNSUPPORTED", 20_001)}
    # some rows of state per bucket and band, not some per execution
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 6000


def test_reclaim_acknowledged_in_a_later_batch(spark):
    schema = "msg_id int, at timestamp, kind string, retries int, data string"
    rows = [(1, t(0), "delivered", 0, "a"), (2, t(0), "delivered", 0, "b"), (3, t(1), "delivered", 3, "c"),
            (2, t(100), "acked", 0, None), (4, t(120), "delivered", 0, "d"), (4, t(200), "delivered", 1, "d"),
            (9, t(450), "delivered", 0, "z"), (9, t(451), "acked", 0, None)]
    out = folder()
    stream = read_message_stream(spark, files(spark, rows, schema), schema, "parquet", slots=1)
    run_available(SS.reclaim_stream(stream, late_s=0), path=out, settings=SS.ROCKSDB)
    got = {r.msg_id: (r.route, r.next_retries) for r in spark.read.parquet(out).collect()}
    assert got == {"1": ("requeue", 1), "3": ("dlq", None)}


def test_reclaim_keeps_state_per_bucket_of_messages(spark):
    schema = "msg_id int, at timestamp, kind string, retries int, data string"
    rows = [[(i, t(i % 50), "delivered", i % 5, f"m{i}") for i in range(4000)] + [(5000, t(200), "delivered", 2, "new")],
            # an older delivery that comes later does not count, an acknowledgement does
            [(5000, t(150), "delivered", 1, "old")] + [(i, t(60), "acked", 0, None) for i in range(0, 4000, 2)],
            [(9000, t(2000), "acked", 0, None)]]
    path, out = folder(), folder()
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = read_message_stream(spark, path, schema, "parquet", slots=1)
    query = run_available(SS.reclaim_stream(stream, late_s=100), path=out, settings=SS.ROCKSDB, partitions=4)
    got = {(r.msg_id, r.data, r.route, r.reason, r.next_retries) for r in spark.read.parquet(out).collect()}
    want = {(str(i), f"m{i}", "requeue", None, i % 5 + 1) if i % 5 < 3 else (str(i), f"m{i}", "dlq", "max_retries_exceeded", None)
            for i in range(1, 4000, 2)}
    assert got == want | {("5000", "new", "requeue", None, 3)}
    # some rows of state per bucket, not some per message
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 2000


LOGGED = "id int, execution_id string, workflow_id string, organization_id int, created_at timestamp, event_type string"


def test_status_over_batches(spark):
    """Against the batch answer, in disorder, with bands that end and executions that go on after."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        at = i * 60 + rng.randrange(600)
        rows.append((i, f"x{i // 40}-{rng.randrange(3)}", "w", i % 5 or None, t(at), rng.choice([K.STARTED, K.STEP_COMPLETED, K.FAILED])))
    rows += [(1000, "x0-0", "w2", 3, t(30_000), K.COMPLETED)]
    out = folder()
    stream = read_message_stream(spark, files(spark, rows, LOGGED, 6), LOGGED, "parquet", slots=1)
    states = SS.execution_state(stream, band_s=1800, late_s=600)
    query = run_available(states, mode="update", each=SS.status_batch(out, 600))
    want = {}
    for x in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == x), key=lambda r: (r[4], r[0]))
        want[x] = (own[-1][0], own[-1][3], len(own))
    got = {r.execution_id: (r.event_id, r.organization_id, r.events) for r in SS.status_table(spark, out).collect()}
    assert got == want
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert sizes[-1] < max(sizes) < 200  # state shrinks
    left = SS._bands(spark, out)
    assert left.filter("not ended").select("batch_id").distinct().count() <= 2
    assert left.filter("ended").count() > 2 * left.filter("not ended").count()


def test_pipeline_repeats_a_batch_without_doubling(spark):
    cols = ("id int, execution_id string, workflow_id string, organization_id int, created_at timestamp,"
            " event_type string, error_type string")
    log = spark.createDataFrame([(i, f"x{i}", "w" if i < 4 else "gone", 1, t(i), K.STARTED, None) for i in range(5)], cols)
    catalog = spark.createDataFrame([("w", ["download_file", "odd"])], "id string, steps array<string>")
    hooks = spark.createDataFrame([(7, 1, "u"), (8, 1, "v"), (9, 2, "w")], "id int, organization_id int, url string")
    rows = [(i, f'{{"workflow_execution_id":"x{i}"}}', 2 if i == 2 else 0) for i in range(6)] + [(9, "{bad", 0)]
    batch = spark.createDataFrame(rows, "msg_id int, data string, retries int")

    class RetryableException(Exception):
        pass

    def run(row):
        assert list(row["steps"]) == ["download_file"]
        if row["id"] in (1, 2):
            raise RetryableException("later")
        if row["id"] == 3:
            raise ValueError("broken")
        return {"properties": []}

    out = folder()
    write = SP.pipeline_batch(out, lambda: log, catalog, hooks, run, "worker-1")
    for _ in range(2):
        write(batch, 0)
    routes = {r.msg_id: (r.route, r.reason, r.next_retries) for r in spark.read.parquet(f"{out}/routes").collect()}
    assert routes == {
        0: ("ack", None, None), 1: ("requeue", None, 1), 2: ("dlq", "max_retries_exceeded", None),
        3: ("dlq", "not_retryable_error", None), 4: ("dlq", "not_retryable_error", None),
        5: ("dlq", "not_retryable_error", None), 9: ("dlq", "decode_error", None)}
    events = {r.msg_id: r.event_type for r in spark.read.parquet(f"{out}/events").collect()}
    assert events == {0: K.COMPLETED, 1: K.FAILED, 2: K.FAILED, 3: K.FAILED}
    told = sorted((r.msg_id, r.webhook_id) for r in spark.read.parquet(f"{out}/notifications").collect())
    assert told == [(i, h) for i in (0, 2, 3, 4) for h in (7, 8)]
