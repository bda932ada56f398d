"""User code per row: custom metrics, extractors and dataset builders.

The functions run in Arrow batches on the executors. They are shipped by value, so
they must not depend on modules that only the driver can import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RETRYABLE_ERROR, TIME_KEY
from ..functions.labels import create_task, map_to_results
from ..functions.properties import truthy_properties
from ..functions.text import last_wins_map

_OBSERVED = (
    "task_id bigint, model_version string, prediction_id bigint, score double,"
    " observation string, output string, processing_time_ms double, failed boolean"
)
_PROPERTIES = "array<struct<name:string,value:string,type:string>>"


def evaluate_custom(pairs: DataFrame, metric: Callable[[dict, dict, str | None], tuple]) -> DataFrame:
    """Score pairs with ``metric(prediction, truth, document_type)``.

    It returns (score, observation JSON, output). A failing row becomes an error
    observation with score 0.
    """

    def run(batches):
        import json

        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    prediction = dict(r.prediction) if r.prediction is not None else {}
                    truth = dict(r.truth) if r.truth is not None else {}
                    score, observation, output = metric(prediction, truth, r.document_type)
                    failed = False
                    output = output if output is None or isinstance(output, str) else json.dumps(output)
                except Exception as exc:  # noqa: BLE001 - user code may raise anything
                    score, output, failed = 0.0, None, True
                    observation = json.dumps({"error": str(exc)})
                rows.append((r.task_id, r.model_version, r.prediction_id, float(score),
                             observation, output, r.processing_time_ms, failed))
            yield pd.DataFrame(rows, columns=[
                "task_id", "model_version", "prediction_id", "score", "observation",
                "output", "processing_time_ms", "failed",
            ])

    inputs = pairs.select("task_id", "model_version", "prediction_id", "processing_time_ms",
                          "document_type", "truth", "prediction")
    return inputs.mapInPandas(run, _OBSERVED)


def predict(
    tasks: DataFrame,
    extract: Callable[[dict], dict],
    key: str = "id",
    n_partitions: int | None = None,
    workflow_id: str = "workflow",
    model_version: str | None = None,
) -> DataFrame:
    """Run an extractor on every task row.

    ``extract(row)`` returns a dict with ``properties`` (list of name/value/type) and
    optionally ``execution_id`` and ``total_processing_time_ms``. Each row gets its
    own success, error and time; an exception class named like the retryable error
    (or derived from it) is reported as that. The result list and the model version
    are those a prediction would be stored with. ``n_partitions`` spreads slow
    extractors.
    """
    retryable = RETRYABLE_ERROR
    keyed_by_execution = key == "execution_id"
    own = "" if keyed_by_execution else "execution_id string, "
    schema = (
        f"{key} {tasks.schema[key].dataType.simpleString()}, success boolean, error string,"
        f" error_type string, {own}"
        f"{TIME_KEY} double, properties {_PROPERTIES}"
    )

    def run(batches):
        import time

        import pandas as pd

        names = [key, "success", "error", "error_type", "run", "total_processing_time_ms", "properties"]
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                begin = time.perf_counter()
                try:
                    found = extract(row)
                    spent = found.get("total_processing_time_ms")
                    if spent is None:
                        spent = (time.perf_counter() - begin) * 1000
                    properties = [
                        {
                            "name": p.get("name"),
                            "value": None if p.get("value") is None else str(p["value"]),
                            "type": p.get("type", "string"),
                        }
                        for p in found.get("properties") or []
                    ]
                    rows.append((row[key], True, None, None, found.get("execution_id"), float(spent), properties))
                except Exception as exc:  # noqa: BLE001 - user code may raise anything
                    kinds = [c.__name__ for c in type(exc).__mro__]
                    kind = retryable if retryable in kinds else kinds[0]
                    rows.append((row[key], False, str(exc), kind, None, None, None))
            done = pd.DataFrame(rows, columns=names)
            yield (
                done.drop(columns="run") if keyed_by_execution
                else done.rename(columns={"run": "execution_id"})
            )

    spread = tasks if n_partitions is None else tasks.repartition(n_partitions)
    done = spread.mapInPandas(run, schema)
    kept = truthy_properties("properties")
    fields = last_wins_map(
        F.transform(kept, lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")))
    )
    metadata = F.to_json(F.struct(F.col(TIME_KEY)))
    return done.select(
        "*",
        F.when(F.col("success"), map_to_results(fields, metadata)).alias("result"),
        F.lit(model_version or workflow_id).alias("model_version"),
    )


def build_dataset(
    files: DataFrame,
    extract: Callable[[dict], dict],
    url: str = "path",
    n_partitions: int | None = None,
) -> DataFrame:
    """Run an extractor over a file table and turn successes into labelling tasks.

    Adds ``task``: the task with the extracted values as ground truth.
    """
    results = predict(files, extract, key=url, n_partitions=n_partitions)
    kept = truthy_properties("properties")
    truth = last_wins_map(
        F.transform(kept, lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")))
    )
    return results.select(
        url, "success", "error", "execution_id",
        F.when(F.col("success"), create_task(url, truth)).alias("task"),
    )
