"""File names, storage URLs, content types and page geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .binding import let
from .numbers import ColumnOrName, _c
from .text import sanitize_metadata


def _base64_text(text: Column) -> Column:
    return F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def extract_storage_url(url: ColumnOrName) -> Column:
    """Storage URL behind a task URL.

    Storage URLs pass through; a ``fileuri`` query parameter is decoded whatever it
    holds; a text that is base64 of a storage URL is decoded; the rest is unchanged.
    """
    text = _c(url)
    parameter = F.url_decode(F.regexp_extract(text, r"\?(?:[^#]*&)?fileuri=([^&#]+)", 1))
    from_parameter = let(parameter, lambda p: F.when(p != "", _base64_text(p)))
    decoded = let(_base64_text(text), lambda t: F.when(t.startswith("s3://"), t))
    return F.coalesce(F.when(text.startswith("s3://"), text), from_parameter, decoded, text)


def parse_storage_url(url: ColumnOrName) -> Column:
    """struct(bucket, key, error): exactly one of key and error is set."""
    text = _c(url)
    shape = r"(?s)^s3://([^/]*)/(.*)$"
    ok = text.rlike(shape)
    return F.struct(
        F.when(ok, F.regexp_extract(text, shape, 1)).alias("bucket"),
        F.when(ok, F.regexp_extract(text, shape, 2)).alias("key"),
        F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("Invalid S3 URL: "),
               F.coalesce(text, F.lit("")))).alias("error"),
    )


def build_storage_url(bucket: ColumnOrName, key: ColumnOrName) -> Column:
    return F.concat(F.lit("s3://"), _c(bucket), F.lit("/"), _c(key))


def file_extension(name: ColumnOrName) -> Column:
    """Lower-case suffix with its dot, or an empty text. A leading dot is no suffix."""
    last = F.regexp_extract(_c(name), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(last, r"^\.*[^.].*(\.[^.]+)$", 1))


def content_type_from_filename(name: ColumnOrName) -> Column:
    lowered = F.lower(_c(name))
    chosen = None
    for mime, extensions in K.MIME_EXTENSIONS.items():
        for ext in extensions:
            hit = lowered.endswith(ext)
            chosen = F.when(hit, mime) if chosen is None else chosen.when(hit, mime)
    return chosen.otherwise(K.OCTET_STREAM)


def extension_from_content_type(content_type: ColumnOrName, default_ext: str = ".png") -> Column:
    """Extension for a content type; unknown types take ``default_ext``.

    With another default than ``.png`` the spellings ``jpg`` and ``png`` are
    recognised as well, as the dataset import does.
    """
    lowered = F.lower(_c(content_type))
    chosen = F.when(lowered.contains("pdf"), ".pdf").when(lowered.contains("jpeg"), ".jpg")
    if default_ext != ".png":
        chosen = chosen.when(lowered.contains("jpg"), ".jpg").when(lowered.contains("png"), ".png")
    return chosen.otherwise(default_ext)


def mime_for_extension(extension: ColumnOrName) -> Column:
    """Allowed MIME type of an extension, null when the extension is not allowed."""
    pairs = [F.lit(x) for mime, exts in K.MIME_EXTENSIONS.items() for e in exts for x in (e, mime)]
    return F.try_element_at(F.create_map(*pairs), _c(extension))


def allowed_extensions() -> Column:
    """Union of the extension lists of all allowed MIME types."""
    lists = [F.array(*[F.lit(e) for e in exts]) for exts in K.MIME_EXTENSIONS.values()]
    union = lists[0]
    for more in lists[1:]:
        union = F.array_union(union, more)
    return union


def sniff_mime(content: ColumnOrName) -> Column:
    """MIME type from the leading bytes, null when none of the known signatures fits."""
    head = F.hex(F.substring(_c(content), 1, 8))
    chosen = None
    for prefix, mime in K.FILE_SIGNATURES.items():
        hit = head.startswith(prefix)
        chosen = F.when(hit, mime) if chosen is None else chosen.when(hit, mime)
    return chosen


def validate_file(name: ColumnOrName, size: ColumnOrName, mime: ColumnOrName) -> Column:
    """struct(is_valid, error, mime): rules in order, the first broken one is reported."""
    known = F.struct(
        file_extension(F.coalesce(_c(name), F.lit(""))).alias("extension"),
        _c(size).alias("size"),
        _c(mime).alias("mime"),
    )
    return let(let(known, _first_broken_rule), _validation)


def _first_broken_rule(known: Column) -> Column:
    extension, detected = known["extension"], known["mime"]
    allowed = list(K.MIME_EXTENSIONS)
    expected = mime_for_extension(extension)
    agrees = (detected == expected) | ((detected == "image/jpg") & (expected == "image/jpeg"))
    error = (
        F.when(known["size"] > K.MAX_FILE_BYTES,
               F.lit(f"File size exceeds maximum limit of {K.MAX_FILE_BYTES / 2**20}MB"))
        .when(~F.array_contains(allowed_extensions(), extension),
              F.lit("File extension not supported. Supported formats: PDF, JPG, PNG"))
        .when(detected.isNull() | (detected == ""),
              F.lit("Could not detect file type from content"))
        .when(~detected.isin(*allowed),
              F.concat(F.lit("File type '"), detected, F.lit("' not supported. Supported types: "
                       + ", ".join(allowed))))
        .when(~agrees,
              F.concat(F.lit("File extension '"), F.ltrim(extension, F.lit(".")),
                       F.lit("' does not match detected content type '"), detected, F.lit("'")))
    )
    return F.struct(error.alias("error"), detected.alias("mime"))


def _validation(found: Column) -> Column:
    return F.struct(
        found["error"].isNull().alias("is_valid"),
        found["error"].alias("error"),
        F.when(found["error"].isNull(), found["mime"]).alias("mime"),
    )


def safe_path_component(value: ColumnOrName) -> Column:
    """Every character outside letters, digits and ``- _ .`` becomes ``_``."""
    return F.regexp_replace(_c(value), r"[^\p{L}\p{Nd}\p{Nl}\p{No}\-_.]", "_")


def or_unknown(value: ColumnOrName) -> Column:
    """Trimmed text, ``unknown`` when missing or blank."""
    return F.coalesce(F.nullif(F.trim(_c(value)), F.lit("")), F.lit("unknown"))


def filename_from_url(url: ColumnOrName) -> Column:
    """Last path segment without the query, ``unknown`` when there is none."""
    path = F.rtrim(F.substring_index(_c(url), "?", 1), F.lit("/"))
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("unknown"))


def file_id(name: ColumnOrName) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(_c(name), r"(?s)\.[^.]*$", "")


def object_key(name: ColumnOrName, day: ColumnOrName, object_id: ColumnOrName) -> Column:
    """``uploads/yyyy/MM/dd/{id}.{extension}``."""
    text = _c(name)
    ext = F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise("")
    return F.concat(
        F.lit("uploads/"), F.date_format(_c(day), "yyyy/MM/dd"), F.lit("/"),
        _c(object_id).cast("string"), F.lit("."), ext,
    )


def object_metadata(
    name: ColumnOrName,
    content_type: ColumnOrName,
    uploaded_at: ColumnOrName,
    object_id: ColumnOrName,
    custom: Column | None = None,
) -> Column:
    """Sanitised metadata map stored next to an object."""
    base = F.create_map(
        F.lit("original-filename"), _c(name),
        F.lit("content-type"), _c(content_type),
        F.lit("upload-timestamp"), F.date_format(_c(uploaded_at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit("file-id"), _c(object_id).cast("string"),
    )
    if custom is not None:
        extra = F.transform_keys(custom, lambda k, _: F.concat(F.lit("custom-"), k))
        base = F.map_concat(base, F.coalesce(extra, F.create_map().cast("map<string,string>")))
    return sanitize_metadata(base)


def page_scale(width: ColumnOrName, height: ColumnOrName) -> Column:
    """Zoom for rendering a page: bounded by edge and area, small pages enlarged."""
    zoom = K.RENDER_DPI / K.NATURAL_DPI
    w, h = _c(width) * zoom, _c(height) * zoom
    edge = F.greatest(w, h)
    clamp = F.least(F.lit(1.0), K.MAX_LONG_EDGE / edge, F.sqrt(K.MAX_PIXELS / (w * h)))
    factor = F.when((clamp == 1.0) & (edge < K.MIN_LONG_EDGE), K.MIN_LONG_EDGE / edge).otherwise(
        clamp
    )
    return factor * zoom
