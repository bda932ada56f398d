"""OCR pages, prompts, barcodes and decoded labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import clean_float_label
from .slices import header_and_items

PAGES_PER_CHUNK = 1000


def _page_chunk(pages_per_chunk: int) -> Column:
    return F.floor(F.col("page_number") / pages_per_chunk).cast("int").alias("chunk")


def _pages_in_order(pages: DataFrame, key: str, render: Column, into: str,
                    pages_per_chunk: int) -> DataFrame:
    lists = pages.groupBy(key, _page_chunk(pages_per_chunk)).agg(
        F.sort_array(F.collect_list(F.struct("page_number", render.alias("t")))).alias("p")
    )
    return lists.select(key, "chunk", F.array_join(F.transform("p", lambda x: x["t"]), "").alias(into))


def assemble_user_prompt(pages: DataFrame, key: str = "execution_id",
                         pages_per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """Page texts in page order, each followed by a blank line; no text prints ``None``.

    A document is one row; one with more pages than ``pages_per_chunk`` is several
    rows whose texts concatenate to the prompt, so no row grows without bound.
    """
    text = F.concat(F.coalesce("text", F.lit("None")), F.lit("\n\n"))
    return _pages_in_order(pages, key, text, "user_prompt", pages_per_chunk)


def page_concat(pages: DataFrame, key: str = "execution_id",
                pages_per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """Pages of a markdown OCR service in one text, each under a page heading."""
    text = F.concat(
        F.lit("Page : "), F.col("page_number").cast("string"), F.lit(" \n "),
        F.coalesce("text", F.lit("None")), F.lit(" \n"),
    )
    return _pages_in_order(pages, key, text, "content", pages_per_chunk)


def prompt_parts(pages: DataFrame, key: str = "execution_id") -> tuple[DataFrame, DataFrame]:
    """The prompt of every document as a header (pages, characters) and one row per page text."""
    return _page_parts(pages, key, F.concat(F.coalesce("text", F.lit("None")), F.lit("\n\n")))


def page_concat_parts(pages: DataFrame, key: str = "execution_id") -> tuple[DataFrame, DataFrame]:
    """The same for the text of a markdown OCR service."""
    return _page_parts(pages, key, F.concat(
        F.lit("Page : "), F.col("page_number").cast("string"), F.lit(" \n "), F.coalesce("text", F.lit("None")), F.lit(" \n"),
    ))


def _page_parts(pages: DataFrame, key: str, render: Column) -> tuple[DataFrame, DataFrame]:
    rows = pages.select(key, "page_number", render.alias("part"))
    return header_and_items(
        rows, [key], [F.col("page_number"), F.col("part")], F.floor(F.col("page_number") / PAGES_PER_CHUNK),
        {"chars": F.sum(F.length("part").cast("long"))},
    )


def barcode_items(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All codes of a document in page order: a header (codes, pages with codes) and one row per code."""
    rows = codes.select("doc_id", "page_number", "pass", "pos", "type", "raw_data")
    order = [F.col(c) for c in ("page_number", "pass", "pos", "type", "raw_data")]
    return header_and_items(
        rows, ["doc_id"], order, F.floor(F.col("page_number") / PAGES_PER_CHUNK), {"last_page": F.max("page_number")}
    )


def barcode_key(kind: Column, raw: Column) -> Column:
    """Identity of a code on its page; kinds without a key are not reported.

    A 2D-Doc is a decoded data matrix, so the two are the same code when their texts agree.
    """
    return F.when(kind.isin("DATA_MATRIX", "2D_DOC"), F.concat(F.lit("dm:"), raw)).when(
        kind == "QR", F.concat(F.lit("qr:"), raw)
    )


def dedupe_barcodes(codes: DataFrame) -> DataFrame:
    """First occurrence of each code per page, by pass and position.

    The minimum per (page, key) is taken map-side first, so copies of one code never
    travel together to one task.
    """
    body = F.struct("pass", "pos", "tie", "type", "raw_data")
    keyed = codes.withColumn("key", barcode_key(F.col("type"), F.col("raw_data"))).filter(
        F.col("key").isNotNull()
    )
    return (
        keyed.groupBy("doc_id", "page_number", "key").agg(F.min(body).alias("b"))
        .select("doc_id", "page_number", "key", "b.*")
    )


def specialised_pages(codes: DataFrame, kind: str = "2D_DOC") -> DataFrame:
    """Pages where the first pass already found a code of the special kind."""
    hit = (F.col("pass") == 1) & (F.col("type") == kind)
    return codes.filter(hit).select("doc_id", "page_number").distinct()


def needs_second_pass(pages: DataFrame, codes: DataFrame, kind: str = "2D_DOC") -> DataFrame:
    """Pages to scan again, cheap test before the expensive scan."""
    return pages.join(specialised_pages(codes, kind), ["doc_id", "page_number"], "left_anti")


def union_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def merged_passes(codes: DataFrame, kind: str = "2D_DOC") -> DataFrame:
    """First-pass codes, second-pass codes only where the first pass was not enough,
    then one of each per page."""
    first = codes.filter(F.col("pass") == 1)
    second = needs_second_pass(codes.filter(F.col("pass") == 2), first, kind)
    return dedupe_barcodes(union_passes(first, second))


def flatten_barcodes(codes: DataFrame, pages_per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """All codes of a document in page order as one list, chunked by page range."""
    item = F.struct("page_number", "pass", "pos", "type", "raw_data")
    lists = codes.groupBy("doc_id", _page_chunk(pages_per_chunk)).agg(
        F.sort_array(F.collect_list(item)).alias("barcodes")
    )
    return lists.select("doc_id", "chunk", "barcodes")


def map_labels_to_fields(items: DataFrame, required: tuple[str, ...] = K.REQUIRED_LABELS,
                         key: str = "doc_id") -> DataFrame:
    """Decoded (label, value, pos) items to one field map per document.

    Curly apostrophes are straightened, unmapped labels dropped, number fields must
    parse or the field is dropped; a repeated field keeps its last value. Documents
    without all required fields are left out. The map holds at most one entry per
    mapped label.
    """
    spark = items.sparkSession
    mapping = F.broadcast(
        spark.createDataFrame(list(K.LABEL_TO_FIELD.items()), "label string, field string")
    )
    straight = F.trim(F.translate("label", "’", "'"))
    mapped = items.withColumn("label", straight).join(mapping, "label")
    number = clean_float_label("value")
    is_number = F.col("field").isin(*K.NUMBER_LABELS)
    cleaned = mapped.withColumn(
        "value", F.when(is_number, number.cast("string")).otherwise(F.col("value"))
    ).filter(F.col("value").isNotNull())
    latest = cleaned.groupBy(key, "field").agg(F.max_by("value", "pos").alias("value"))
    folded = latest.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields")
    )
    return folded.filter(has_required(F.map_keys("fields"), required))


def has_required(names: Column, required: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), names)) == 0


def last_records(records: DataFrame, key: str, name: str = "name", value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per key and name with its last value, however many names a key has."""
    return records.groupBy(key, name).agg(F.max_by(value, pos).alias("value"))


def records_to_map(records: DataFrame, key: str, name: str = "name", value: str = "value",
                   pos: str = "pos") -> DataFrame:
    """(key, name, value, pos) rows to one map per key; a repeated name keeps the last."""
    last = records.groupBy(key, name).agg(F.max_by(value, pos).alias("v"))
    return last.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "v")))).alias("fields")
    )
