"""Tables of one small file must not be the work of one task."""

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import evaluation as E
from fieldglass.operators import experiments as X
from fieldglass.workload import all_types, scalars
from fieldglass.workload.views import Inputs

DATA = "/root/testdata/sf0.01"


def tasks_of(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().count()


@pytest.mark.parametrize("rows", [lambda v: v.label_tasks, all_types.typed_pairs], ids=["label_tasks", "typed_pairs"])
def test_customers_are_dealt_to_all_cores(spark, rows):
    made = rows(Inputs(spark, DATA))
    assert tasks_of(made) >= spark.sparkContext.defaultParallelism
    assert made.count() == Inputs(spark, DATA).customer.count()


@pytest.mark.parametrize("name", ["deep_compare_nested", "deep_compare_json"])
def test_deep_comparisons_are_dealt_to_all_cores(spark, name):
    compared = getattr(scalars, name)(Inputs(spark, DATA))
    assert tasks_of(compared) >= spark.sparkContext.defaultParallelism


def test_empty_containers_and_scalars_stay_apart(spark):
    rows = [("[]", "{}", 0.0), ("[[]]", "[{}]", 0.0), ("[null]", "[]", 0.0), ('["[null"]', "[]", 0.0), ('{"a":[]}', '{"a": []}', 1.0),
            ('["[", 1]', '[1, "["]', 1.0), ('"]"', '"["', 0.0)]
    df = spark.createDataFrame([(i, e, p) for i, (e, p, _) in enumerate(rows)], "id int, expected string, predicted string")
    got = [r.score for r in E.deep_json_scores(df).orderBy("id").collect()]
    assert got == [want for _, _, want in rows]


@pytest.fixture
def large(spark):
    """Settings under which small tables are joined like large ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name in settings:
        spark.conf.unset(name)


@pytest.fixture
def busy(large):
    """Experiments and observations; one experiment has half of all observations."""
    runs = large.range(2000).select("id", F.lit("m").alias("metric_name"))
    made = large.range(0, 1000000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 1000).alias("experiment_id"), F.col("id").alias("task_id"),
        F.col("id").alias("prediction_id"), F.lit("v").alias("model_version"), F.rand(1).alias("score"),
        F.rand(2).alias("processing_time_ms"),
    )
    return runs, made


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _busiest(df):
    """Rows of the largest task; all columns are read, since their bytes decide the tasks."""
    rows = df.withColumn("p", F.spark_partition_id())
    counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*rows.columns)))
    return max(r.n for r in counts.collect())


def test_experiment_export_sorts_no_observations(busy):
    out = X.export_experiments(*busy, F.lit("{}"))
    assert "Sort" not in _plan(out)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join "):]
    assert "Json" in plan and "Json" not in below[:below.index("Range")]  # built of joined rows
    assert out.count() == 1000000 + 1500
    assert _busiest(out) < 200000


def test_experiment_delete_sorts_no_observations(busy):
    runs, made = busy
    kept, left = X.delete_cascade(runs, made, runs.filter("id > 500").unionByName(runs.filter("id > 900")))
    assert "Sort" not in _plan(kept) + _plan(left)
    assert (kept.count(), left.count()) == (501, 500000 + 250000)
    assert _busiest(left) < 200000
