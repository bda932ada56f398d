"""File tables: validation and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.files import content_type_from_filename, filename_from_url, sniff_mime, validate_file


def validate_files(files: DataFrame, name: str = "filename", size: str = "size",
                   mime: str = "detected_mime") -> DataFrame:
    return files.withColumn("check", validate_file(name, size, mime))


def validate_binary_files(files: DataFrame) -> DataFrame:
    """Validation of a ``binaryFile`` scan. Content is looked at only by its first bytes."""
    named = files.select(
        "path", filename_from_url("path").alias("filename"), F.col("length").alias("size"),
        sniff_mime("content").alias("detected_mime"),
    )
    return validate_files(named)


def has_input(rows: DataFrame, file: str = "file", url: str = "file_url") -> DataFrame:
    return rows.filter(F.col(file).isNotNull() | F.col(url).isNotNull())


def object_inventory(files: DataFrame) -> DataFrame:
    """Key, size, content type and time of stored objects, without reading contents."""
    return files.select(
        F.col("path").alias("key"),
        F.col("length").alias("size"),
        content_type_from_filename("path").alias("content_type"),
        F.col("modificationTime").alias("last_modified"),
    )
