"""Scans. Every reader has a declared schema, so nothing is inferred and columns and
filters that a query does not need are pruned at the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.dates import strip


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to four tasks per core.

    For tables that are small on disk and slow to work on row by row: a file of a few MB or of
    one row group is one task otherwise, however many rows it holds.
    """
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism, *keys)


def scan_event_store(spark: SparkSession, path: str) -> DataFrame:
    """Event log. Files written before redaction existed read as PENDING."""
    events = spark.read.schema(S.EVENT_STORE).parquet(path)
    return events.withColumn(
        "anonymization_status", F.coalesce("anonymization_status", F.lit("PENDING"))
    )


def scan_event_store_jdbc(spark: SparkSession, url: str, table: str, lower: str, upper: str,
                          num_partitions: int, **options: str) -> DataFrame:
    """Event log in a relational database, read in parallel ranges of the event time."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="created_at", lowerBound=lower,
                 upperBound=upper, numPartitions=num_partitions, **options)
        .load()
        .withColumn("anonymization_status", F.coalesce("anonymization_status", F.lit("PENDING")))
    )


def scan_label_tasks(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Labelling tasks, all files at once (the files are the pages of the project)."""
    return spark.read.schema(S.LABEL_TASK).option("multiLine", multiline).json(path)


def scan_workflow_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid workflows in file order, rejected records).

    A record without all its members is rejected, an unreadable file raises. The
    catalog is one small file, so its order is the order of the rows in it.
    """
    raw = (
        spark.read.schema(S.WORKFLOWS + ", _corrupt_record string")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("position", F.monotonically_increasing_id())
    )
    ok = F.col("_corrupt_record").isNull()
    for name in raw.columns:
        if name not in ("_corrupt_record", "position"):
            ok = ok & F.col(name).isNotNull()
    return raw.filter(ok).drop("_corrupt_record"), raw.filter(~ok)


def scan_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EXPERIMENTS).parquet(path)


def scan_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.OBSERVATIONS).parquet(path)


def scan_organizations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ORGANIZATIONS).parquet(path)


def scan_api_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.API_KEYS).parquet(path)


def scan_webhooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.WEBHOOKS).parquet(path)


def scan_file_ids_csv(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed values of the column ``file_id``."""
    ids = spark.read.option("header", True).csv(path).select(strip("file_id").alias("file_id"))
    return ids.filter(F.col("file_id") != "")


def scan_documents_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Raw files. Select without ``content`` and Spark does not open them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def scan_ocr_pages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """OCR results, one row per page."""
    return (
        spark.read.schema(S.OCR_PAGES)
        .option("multiLine", multiline)
        .json(path)
        .select(F.col("_metadata.file_path").alias("source"), F.inline("pages"))
    )


def scan_replay_payloads(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Replay payloads; unreadable or incomplete ones are absent."""
    return split_replay_payloads(spark, path, multiline)[0]


def split_replay_payloads(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(payloads, rejected records): a record is rejected with its text when it cannot be read,
    otherwise with what it lacks."""
    required = ["execution_id", "document_type", "model", "system_prompt", "user_prompt"]
    raw = (
        spark.read.schema(S.REPLAY + ", _corrupt_record string")
        .option("multiLine", multiline)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    lacking = F.array_compact(F.array(*[F.when(F.col(name).isNull(), name) for name in required]))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(
        F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", "))
    )
    judged = raw.withColumn("reason", reason)
    rejected = judged.filter(F.col("reason").isNotNull()).select(
        F.col("_corrupt_record").alias("record"), "execution_id", "reason", F.col("_metadata.file_name").alias("file")
    )
    return judged.filter(F.col("reason").isNull()).select(*required), rejected


def scan_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
