"""Files, storage URLs, decoded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import files as fn
from ..operators import files as O
from ..operators import pages as P
from .registry import query
from .views import Inputs, r6


@query("file_validation", sql="""
WITH f AS (SELECT *, lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) AS ext FROM files),
g AS (SELECT *, CASE ext WHEN '.pdf' THEN 'application/pdf' WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' END AS want FROM f),
h AS (SELECT *, CASE WHEN size > 26214400 THEN 'File size exceeds maximum limit of 25.0MB'
  WHEN want IS NULL THEN 'File extension not supported. Supported formats: PDF, JPG, PNG'
  WHEN detected_mime = 'text/plain' THEN 'File type ''text/plain'' not supported. Supported types: application/pdf, image/jpeg, image/png'
  WHEN detected_mime <> want THEN 'File extension ''' || substr(ext, 2) || ''' does not match detected content type ''' || detected_mime || '''' END AS error FROM g)
SELECT id, error IS NULL AS is_valid, error, CASE WHEN error IS NULL THEN detected_mime END AS mime FROM h""")
def file_validation(v: Inputs) -> DataFrame:
    return O.validate_files(v.files).select("id", "check.*")


@query("has_input", sql="SELECT id FROM files WHERE id % 5 <> 4 OR id % 4 = 0")
def has_input(v: Inputs) -> DataFrame:
    inputs = v.files.select(
        "id",
        F.when(F.col("id") % 5 != 4, F.col("filename")).alias("file"),
        F.when(F.col("id") % 4 == 0, F.lit("https://x")).alias("file_url"),
    )
    return O.has_input(inputs).select("id")


@query("mime_sniff", sql="""
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' END AS mime
FROM documents""")
def mime_sniff(v: Inputs) -> DataFrame:
    head = (
        F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("255044462D312E37")))
        .when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("FFD8FFE0")))
        .when(F.col("doc_id") % 4 == 2, F.unhex(F.lit("89504E470D0A1A0A")))
        .otherwise(F.unhex(F.lit("00")))
    )
    content = F.concat(head, F.encode("text", "UTF-8"))
    return v.documents.select(F.col("doc_id").alias("id"), fn.sniff_mime(content).alias("mime"))


@query("url_parts", sql="""
SELECT page_id, 's3://bucket/pages/' || page_id || '.html' AS storage_url, 'bucket' AS bucket,
  'pages/' || page_id || '.html' AS key,
  CASE WHEN rtrim(split_part(url, '?', 1), '/') = '' THEN 'unknown'
    ELSE regexp_extract(rtrim(split_part(url, '?', 1), '/'), '([^/]*)$', 1) END AS filename,
  regexp_replace(url, '[^A-Za-z0-9._\\-]', '_', 'g') AS safe, 'application/octet-stream' AS content_type
FROM pages""")
def url_parts(v: Inputs) -> DataFrame:
    plain = F.concat(F.lit("s3://bucket/pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    coded = F.translate(F.base64(F.encode(plain, "UTF-8")), "\r\n", "")
    given = (
        F.when(F.col("page_id") % 3 == 0, plain)
        .when(F.col("page_id") % 3 == 1,
              F.concat(F.lit("https://x.example.org/r?a=1&fileuri="), F.url_encode(coded)))
        .otherwise(coded)
    )
    out = v.pages.select("page_id", "url", fn.extract_storage_url(given).alias("storage_url"))
    parts = fn.parse_storage_url("storage_url")
    return out.select(
        "page_id", "storage_url", parts["bucket"].alias("bucket"), parts["key"].alias("key"),
        fn.filename_from_url("url").alias("filename"), fn.safe_path_component("url").alias("safe"),
        fn.content_type_from_filename("storage_url").alias("content_type"),
    )


@query("file_names", sql="""
SELECT id, CASE WHEN lower(filename) LIKE '%.pdf' THEN 'application/pdf' WHEN lower(filename) LIKE '%.jpg' THEN 'image/jpeg'
  WHEN lower(filename) LIKE '%.png' THEN 'image/png' ELSE 'application/octet-stream' END AS content_type,
  CASE WHEN detected_mime = 'application/pdf' THEN '.pdf' WHEN detected_mime = 'image/jpeg' THEN '.jpg' ELSE '.png' END AS extension,
  CASE detected_mime WHEN 'application/pdf' THEN '.pdf' WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/png' THEN '.png' ELSE '.bin' END AS extension_or_bin,
  'doc-' || id AS file_id FROM files""")
def file_names(v: Inputs) -> DataFrame:
    return v.files.select(
        "id",
        fn.content_type_from_filename("filename").alias("content_type"),
        fn.extension_from_content_type("detected_mime").alias("extension"),
        fn.extension_from_content_type("detected_mime", ".bin").alias("extension_or_bin"),
        fn.file_id("filename").alias("file_id"),
    )


@query("object_keys", sql="""
SELECT f.id, 'uploads/2024/03/' || lpad(CAST(1 + f.id % 28 AS VARCHAR), 2, '0') || '/' || f.id || '.'
  || CASE WHEN f.filename LIKE '%.%' THEN regexp_extract(f.filename, '([^.]*)$', 1) ELSE '' END AS key,
  f.filename AS original, 'lang ' || d.lang AS custom
FROM files f JOIN documents d ON d.doc_id = f.id""")
def object_keys(v: Inputs) -> DataFrame:
    day = F.make_date(F.lit(2024), F.lit(3), (1 + F.col("id") % 28).cast("int"))
    rows = v.files.join(v.documents.select(F.col("doc_id").alias("id"), "lang"), "id")
    custom = F.create_map(F.lit("Doc Lang"), F.concat(F.lit("lang\n"), "lang"))
    metadata = fn.object_metadata("filename", "detected_mime", day, "id", custom)
    out = rows.select("id", fn.object_key("filename", day, "id").alias("key"), metadata.alias("m"))
    return out.select("id", "key", F.col("m")["original-filename"].alias("original"),
                      F.col("m")["custom-doc-lang"].alias("custom"))


@query("page_scale", sql="""
WITH p AS (SELECT p_partkey AS id, (100 + p_size * 40) * 2.5::DOUBLE AS w, (150 + p_partkey % 1200) * 2.5::DOUBLE AS h FROM part),
q AS (SELECT *, least(1.0::DOUBLE, 1800.0 / greatest(w, h), sqrt(2000000.0 / (w * h))) AS c FROM p)
SELECT id, round(2.5 * CASE WHEN c = 1.0 AND greatest(w, h) < 1500 THEN 1500.0 / greatest(w, h) ELSE c END, 6) AS zoom FROM q""")
def page_scale(v: Inputs) -> DataFrame:
    sized = v.part.select(
        F.col("p_partkey").alias("id"),
        (100 + F.col("p_size") * 40).cast("double").alias("width"),
        (150 + F.col("p_partkey") % 1200).cast("double").alias("height"),
    )
    return sized.select("id", r6(fn.page_scale("width", "height")).alias("zoom"))


_LABELS = ("Année des revenus", "Revenu fiscal de référence", "Déclarant 1", "Montant de l’impôt", "Inconnu")


@query("label_mapping", sql="""
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE l_linenumber % 5 WHEN 0 THEN 'Année des revenus'
  WHEN 1 THEN 'Revenu fiscal de référence' WHEN 2 THEN 'Nom du déclarant 1' WHEN 3 THEN 'Montant de l''impôt' END AS field,
  CASE WHEN l_linenumber % 5 = 3 AND l_returnflag = 'R' THEN NULL WHEN l_linenumber % 5 IN (1, 3) THEN CAST(l_quantity AS DOUBLE)::VARCHAR
    ELSE 'v' || l_partkey END AS value, l_partkey, l_extendedprice FROM lineitem),
k AS (SELECT doc_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY pos DESC, l_partkey DESC, l_extendedprice DESC) AS rn
  FROM i WHERE field IS NOT NULL AND value IS NOT NULL) WHERE rn = 1)
SELECT doc_id, field, value FROM k WHERE doc_id IN (SELECT doc_id FROM k
  WHERE field IN ('Année des revenus', 'Revenu fiscal de référence', 'Nom du déclarant 1') GROUP BY 1 HAVING count(*) = 3)""")
def label_mapping(v: Inputs) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _LABELS])
    pick = F.col("l_linenumber") % 5
    number = F.translate(F.col("l_quantity").cast("string"), ".", ",")
    items = v.lineitem.select(
        F.col("l_orderkey").alias("doc_id"),
        F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"),
        F.element_at(names, (pick + 1).cast("int")).alias("label"),
        F.when((pick == 3) & (F.col("l_returnflag") == "R"), "n/a").when(pick.isin(1, 3), number)
        .otherwise(F.concat(F.lit("v"), F.col("l_partkey").cast("string"))).alias("value"),
    )
    mapped = P.map_labels_to_fields(items, K.REQUIRED_LABELS)
    return mapped.select("doc_id", F.explode("fields").alias("field", "value"))


@query("records_to_map", sql="""
SELECT key, name, value FROM (SELECT l_orderkey AS key, l_returnflag AS name, l_partkey AS value,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def records_to_map(v: Inputs) -> DataFrame:
    rows = v.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("name"),
                             F.col("l_partkey").alias("value"), F.struct("l_linenumber", "l_partkey").alias("pos"))
    out = P.records_to_map(rows, "key")
    return out.select("key", F.explode("fields").alias("name", "value"))


@query("last_records", sql="""
SELECT key, name, value FROM (SELECT l_suppkey AS key, l_returnflag || '-' || l_linestatus AS name, l_partkey AS value,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag || '-' || l_linestatus ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1""")
def last_records(v: Inputs) -> DataFrame:
    rows = v.lineitem.select(F.col("l_suppkey").alias("key"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("name"),
                             F.col("l_partkey").alias("value"), F.struct("l_orderkey", "l_linenumber").alias("pos"))
    return P.last_records(rows, "key")
