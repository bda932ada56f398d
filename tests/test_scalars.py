"""Truth tables of the scalar functions."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass import constants as K
from fieldglass.functions import dates, delivery, files, labels, metrics, numbers, properties, protect, text
from fieldglass.operators import evaluation


def column(spark, values, build, dtype="string"):
    """build(column x) over the values, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {dtype}")
    return [r[1] for r in df.select("i", build(F.col("x"))).orderBy("i").collect()]


def pairs(spark, values, build):
    rows = [(i, a, b) for i, (a, b) in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    return [r[1] for r in df.select("i", build("a", "b")).orderBy("i").collect()]


def test_normalize_number(spark):
    cases = {
        None: None, "": None, "  ": None, "12": 12.0, " 1 234 567 ": 1234567.0, "12,5": 12.5,
        "1 200 €": 1200.0, "1.234,56": None, "1234-56": None, "AB12": 12.0, "12 000": 12000.0,
        "-5": -5.0, "5-": None, ".5": 0.5, "5.": 5.0, "-": None, ".": None, "1-2-3": None,
        "--1": None, "abc": None, "1e5": 15.0, "12%": 12.0, "-.5": -0.5,
    }
    assert column(spark, list(cases), numbers.normalize_number) == list(cases.values())


def test_compare_number(spark):
    cases = [("12", "12.0"), (None, None), ("abc", None), ("12", None), ("12,50", "12.5"), ("1", "2")]
    assert pairs(spark, cases, numbers.compare_number) == [1.0, 1.0, 1.0, 0.0, 1.0, 0.0]


def test_normalize_string_date(spark):
    d = dt.date
    cases = {
        None: None, "": None, "01/02/2024": d(2024, 2, 1), "1/2/2024": d(2024, 2, 1),
        "01-02-2024": d(2024, 2, 1), "01.02.2024": d(2024, 2, 1), "01022024": d(2024, 2, 1),
        "2024/02/01": d(2024, 2, 1), "2024-2-1": d(2024, 2, 1), "2024.02.01": d(2024, 2, 1),
        "20240131": d(2024, 1, 31), "10111213": d(1213, 11, 10), " 01/02/2024 ": d(2024, 2, 1),
        "29/02/2023": None, "31/04/2024": None, "01/01/24": None, "1/1/12024": None,
        "01/02-2024": None, "2024-13-01": None, "00/01/2024": None, "01/01/0000": None,
        "2024-01-01T00:00": None, "soon": None, "01/ 2/2024": None, "2024/01/ 5": d(2024, 1, 5),
    }
    assert column(spark, list(cases), dates.normalize_string_date) == list(cases.values())


def test_compare_string_date(spark):
    cases = [("01/02/2024", "2024-02-01"), (None, None), ("x", "x"), ("01/02/2024", None)]
    assert pairs(spark, cases, dates.compare_string_date) == [1.0, 0.0, 0.0, 0.0]


def test_parse_flexible_date(spark):
    d = dt.date
    cases = {
        "2026-02-29": (d(2026, 2, 28), True, False), "31/04/2026": (d(2026, 4, 30), True, False),
        "31-06-2026": (d(2026, 6, 30), True, False), "2024-1-1": (d(2024, 1, 1), False, False),
        "1.1.2024": (d(2024, 1, 1), False, False), None: (None, False, False),
        " None ": (None, False, False), "null": (None, False, False), "": (None, False, False),
        "not-a-date": (None, False, True), "2024-13-01": (None, False, True),
        "00/01/2024": (None, False, True), "1/1-2024": (None, False, True),
        "99/12/2024": (d(2024, 12, 31), True, False),
    }
    got = column(spark, list(cases), dates.parse_flexible_date)
    assert [(r.value, r.clamped, r.error is not None) for r in got] == list(cases.values())


def python_normal(s):
    s = unicodedata.normalize("NFD", s.lower().replace("œ", "oe").replace("æ", "ae"))
    s = "".join(c for c in s if unicodedata.category(c) != "Mn")
    return "".join(c for c in s if c not in " \t\n\r.-_'")


def test_fold_every_decomposable_character(spark):
    chars = text._decomposable() + [chr(c) for c in range(0xAC00, 0xD7A4, 97)] + ["ß", "漢", "𝒳", "€"]
    values = ["a" + c + "b" for c in chars]
    want = [
        "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn")
        for v in values
    ]
    assert column(spark, values, text.fold_accents) == want


def test_to_ascii_every_decomposable_character(spark):
    values = ["a" + c + "b" for c in text._decomposable() + ["ß", "漢", "€"]]
    want = [
        unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().strip() for v in values
    ]
    assert column(spark, values, text.to_ascii) == want


def test_normalize_for_distance(spark):
    values = ["Élodie Martin", "Jean-Pierre_D'Arc.", "CŒUR Æther", "a\tb\nc\rd", "x/y", "a b", "한글 é", ""]
    assert column(spark, values, text.normalize_for_distance) == [python_normal(v) for v in values]


def test_similarity(spark):
    cases = [("kitten", "sitting"), ("", ""), ("a", ""), (None, None), (None, "x"), ("Élodie", "elodie"),
             ("Jean-Pierre", "jean pierre"), ("abc", "xyz"), ("- . _", "''")]
    got = pairs(spark, cases, text.compare_levenshtein)
    assert got == pytest.approx([1 - 3 / 7, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0])
    assert pairs(spark, cases, text.levenshtein_distance) == [3, 0, 1, 0, 1, 0, 0, 3, 0]


def test_similarity_is_symmetric(spark):
    words = ["", "a", "Été", "ete", "martin", "marte", "한", None]
    cases = [(a, b) for a in words for b in words]
    there = pairs(spark, cases, text.compare_levenshtein)
    back = pairs(spark, [(b, a) for a, b in cases], text.compare_levenshtein)
    assert there == back and all(0 <= s <= 1 for s in there)


def test_token_set(spark):
    cases = [("prenom nom", "nom prenom"), ("jean-pierre dupont", "dupont jean pierre"),
             ("Élodie Martin", "martin elodie"), ("nom   prenom", "prenom nom"), ("a/b", "b a"),
             ("prenom nom", "prenom"), ("", "nom"), (None, "nom"), ("", ""), (None, " - "), ("a a b", "b a")]
    assert pairs(spark, cases, text.compare_token_set) == [1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1]


def test_person_names(spark):
    cases = {
        "M. MARTIN Thomas": "MARTIN Thomas", "Mme, DUPONT Jeanne": "DUPONT Jeanne",
        "Docteur DURAND Alice": "DURAND Alice", "Dr.  LAFONTAINE, Patrice": "LAFONTAINE Patrice",
        "MARTIN Thomas": "MARTIN Thomas", " monsieur  le  Pr. X ": "le Pr. X", "M. Dr. House": "House",
        "": None, " , ": None, None: None, "Mathilde": "Mathilde", "M": "M",
    }
    assert column(spark, list(cases), text.normalize_person_name) == list(cases.values())


def test_metric_dispatch(spark):
    df = spark.createDataFrame(
        [(m, "1,0", "1.0") for m in K.METRICS] + [("bogus", "a", "a")], "m string, e string, p string")
    got = {r.m: r.s for r in df.select("m", metrics.score(F.col("m"), "e", "p").alias("s")).collect()}
    assert got == {"equality": 0.0, "levenshtein_distance": pytest.approx(1 - 1 / 3), "deep_equality": 0.0,
                   "string_date_equality": 0.0, "compare_number": 1.0, "token_set_equality": 0.0,
                   "skip": -1.0, "bogus": None}


def test_resolve_metrics(spark):
    values = [["levenshtein_distance", "equality"], ["x", "skip"], ["x"], [], None]
    want = [["levenshtein_distance", "equality"], ["skip"], ["equality"], ["equality"], ["equality"]]
    assert column(spark, values, metrics.resolve_metrics, "array<string>") == want
    assert [metrics.resolve_metric_spec(v) for v in ["skip", ["x"], None]] == [["skip"], ["equality"], ["equality"]]


def test_deep_json(spark):
    cases = [('{"a":[1,2]}', '{"a":[2,1,1]}'), ('{"a":1}', '{"a":1.0}'), ("[true]", "[1]"), (None, None),
             ('{"a":null}', "{}"), ('[[1,2],[3]]', '[[3],[2,1]]'), ("oops", "oops"), ("oops", None)]
    assert pairs(spark, cases, metrics.compare_deep_json) == [1, 0, 0, 1, 0, 1, 1, 0]


def test_deep_json_of_any_depth(spark):
    nest = lambda n, x: "[" * n + x + "]" * n
    cases = [(nest(20, "1,2"), nest(20, "2,1,2")), (nest(20, "1"), nest(20, "2")), (nest(3, "1"), nest(4, "1")),
             ('{"a\\"[":{"b":1.50},"c":1e2}', '{"c":100.0,"a\\"[":{"b":1.5}}'), ('{"a":"1"}', '{"a":1}'),
             ('[null,[]]', '[[],null,{}]'), ('{"k":"[[[["}', '{"k":"[[["}'), ('{"a":-0.0}', '{"a":0.0}'), ("", "[]")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, expected string, predicted string")
    scored = evaluation.deep_json_scores(df)
    assert [r.score for r in scored.orderBy("id").collect()] == [1, 0, 0, 1, 0, 0, 0, 1, 0]
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert [r.d for r in df.select("id", metrics.json_depth("expected").alias("d")).orderBy("id").collect()] == [20, 20, 3, 2, 1, 2, 1, 1, 0]


def test_deep_typed(spark):
    kind = "array<struct<a:int,m:map<string,string>>>"
    df = spark.createDataFrame(
        [([(1, {"x": "1", "y": "2"}), (2, None)], [(2, None), (1, {"y": "2", "x": "1"})]),
         ([(1, {"x": "1"})], [(1, {"x": "2"})]), (None, None), ([], None)], f"e {kind}, p {kind}")
    got = df.select(metrics.compare_deep_typed(F.col("e"), F.col("p"), df.schema["e"].dataType)).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 1.0, 0.0]


def test_results_keep_last_duplicate_and_metadata(spark):
    def result(name, *texts):
        return ((list(texts),), name, "pdf", "textarea", False)

    results = [result("a", "1"), result("b", "2", "x"), result("a", "3"), result("", "4"), result("c"),
               result("__metadata__", '{"total_processing_time_ms": 12.5}')]
    df = spark.createDataFrame([(results,), ([],)], f"r array<{labels.RESULT_TYPE}>")
    got = df.select(labels.results_to_map("r"), labels.processing_time("r")).collect()
    assert [tuple(r) for r in got] == [({"a": "3", "b": "2"}, 12.5), ({}, None)]


def test_first_ground_truth(spark):
    kind = f"array<struct<ground_truth:boolean,completed_by:string,result:array<{labels.RESULT_TYPE}>>>"
    full = [((["v"],), "f", "pdf", "textarea", False)]
    values = [[(False, None, full), (True, None, []), (True, None, full)], [(None, None, full)], [], None,
              [(True, None, None)]]
    sizes = lambda c: F.size(c)
    first = column(spark, values, lambda x: sizes(labels.first_ground_truth(x)), kind)
    filled = column(spark, values, lambda x: sizes(labels.first_ground_truth(x, True)), kind)
    assert [n if n is not None and n >= 0 else None for n in first] == [0, None, None, None, 0]
    assert [n if n is not None and n >= 0 else None for n in filled] == [1, None, None, None, None]


def test_validate_file(spark):
    rows = [("a.pdf", 10, "application/pdf"), ("a.pdf", K.MAX_FILE_BYTES + 1, "application/pdf"), ("a.txt", 1, "x"),
            (None, 1, "application/pdf"), ("a.JPEG", 1, "image/jpg"), ("a.png", 1, None), ("a.png", 1, "text/plain"),
            ("a.png", 1, "image/jpeg"), (".pdf", 1, "application/pdf"), ("x/.b.pdf", 1, "application/pdf")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, s bigint, m string")
    got = [r[0] for r in df.orderBy("i").select(files.validate_file("n", "s", "m").alias("c")).select("c.is_valid").collect()]
    # image/jpg is not an allowed detected type, so the tolerance for it never applies
    assert got == [True, False, False, False, False, False, False, False, False, True]


def test_storage_urls(spark):
    import base64

    b64 = base64.b64encode(b"s3://b/k.pdf").decode()
    values = ["s3://b/k.pdf", f"https://h/r?x=1&fileuri={b64.rstrip('=')}", b64, "https://h/plain.pdf",
              f"https://h/r?fileuri={base64.b64encode(b'not-s3').decode()}", None]
    want = ["s3://b/k.pdf", "s3://b/k.pdf", "s3://b/k.pdf", "https://h/plain.pdf", "not-s3", None]
    assert column(spark, values, files.extract_storage_url) == want
    parsed = column(spark, ["s3://b/a/c.pdf", "s3://b", "http://b/k"], files.parse_storage_url)
    assert [(r.bucket, r.key, r.error is None) for r in parsed] == [("b", "a/c.pdf", True), (None, None, False), (None, None, False)]


def test_file_names(spark):
    assert column(spark, ["http://h/a/b.pdf?x=/y", "http://h/a/", "", None, "plain"], files.filename_from_url) == [
        "b.pdf", "a", "unknown", "unknown", "plain"]
    assert column(spark, ["a b/é-1.x_y"], files.safe_path_component) == ["a_b_é-1.x_y"]
    assert column(spark, ["a.tar.gz", "plain", ".x"], files.file_id) == ["a.tar", "plain", ""]


def test_page_scale(spark):
    sizes = [(595.0, 842.0), (100.0, 100.0), (5000.0, 100.0)]

    def want(w, h):
        z = 2.5
        e = max(w * z, h * z)
        c = min(1.0, 1800 / e, (2e6 / (w * z * h * z)) ** 0.5)
        return z * (1500 / e if c == 1.0 and e < 1500 else c)

    df = spark.createDataFrame(sizes, "w double, h double")
    got = [r[0] for r in df.select(files.page_scale("w", "h")).collect()]
    assert got == pytest.approx([want(*s) for s in sizes])


def test_sanitize_metadata(spark):
    pairs_in_order = ["Clé Été", "a\r\nb\tc", "cle-ete", "last", "***", " x  y ", "½", "№ ﬁ"]
    value = F.create_map(*[F.lit(x) for x in pairs_in_order])
    none = F.lit(None).cast("map<string,string>")
    got = spark.range(1).select(text.sanitize_metadata(value), text.sanitize_metadata(none)).first()
    assert got[0] == {"cle-ete": "last", "meta": "x y", "12": "No fi"} and got[1] == {}


def test_mask(spark):
    df = spark.createDataFrame(
        [(("t", [("first", "Alice"), ("age", None)]), "keep")],
        "p struct<type:string,properties:array<struct<name:string,value:string>>>, q string")
    masked = protect.mask(df, {"p": {"properties": {"value": True}}})
    row = masked.first()
    assert [tuple(x) for x in row.p.properties] == [("first", "***"), ("age", None)] and row.q == "keep"
    again = protect.mask(masked, {"p": {"properties": {"value": True}}})
    assert again.collect() == masked.collect()


def test_redact_payload(spark):
    rows = [(0, '{"s3_file_info":{"a":1},"metadata":{"b":2},"n":1}', K.STARTED),
            (1, '{"final_result":{"x":1},"n":2}', K.COMPLETED), (2, '{"error_message":"m"}', K.FAILED),
            (3, "{oops", K.STARTED), (4, "[1]", K.STARTED)]
    df = spark.createDataFrame(rows, "i int, e string, t string")
    got = [r[0] for r in df.orderBy("i").select(protect.redact_payload("e", "t")).collect()]
    assert got == ['{"metadata":{},"n":1,"s3_file_info":{}}', '{"final_result":{},"n":2}', '{"error_message":"m"}', None, None]


def test_routing_columns(spark):
    rows = [(0, "success", 0), (1, "retryable", 0), (2, "retryable", 1), (3, "retryable", 2), (4, "fatal", 0), (5, "retryable", None)]
    df = spark.createDataFrame(rows, "i int, o string, n int")
    got = df.orderBy("i").select(delivery.route("o", "n", F.lit(True)).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [
        ("ack", None, None), ("requeue", None, 1), ("requeue", None, 2), ("dlq", "max_retries_exceeded", None),
        ("dlq", "not_retryable_error", None), ("requeue", None, 1)]


def test_decode_message(spark):
    values = ['{"workflow_execution_id":"x"}', '{"workflow_execution_id":"x","more":1}', '{"other":1}', "{bad", None]
    strict = column(spark, values, lambda x: delivery.decode_message(x, ("workflow_execution_id",), True).isNotNull())
    loose = column(spark, values, lambda x: delivery.decode_message(x, ("workflow_execution_id",), False).isNotNull())
    assert strict == [True, False, False, False, False] and loose == [True, True, False, False, False]


def test_http_and_backoff(spark):
    assert column(spark, [200, 399, 400, 401, 403, 404, 422, 429, 500, 599, 600], delivery.http_retryable, "int") == [
        False, False, False, False, False, True, False, True, True, True, False]
    assert column(spark, [0, 1, 2], delivery.backoff_seconds, "int") == [5.0, 10.0, 20.0]


def test_key_prefix(spark):
    body, good = "A2B3" * 12, "ABCDEFG2"
    values = [f"dia_prod_v1_{good}_{body}_ABCD", f"dia_dev_2_{good}_{body}_ABCD", f"dia_prod_v1_{good}_{body}_ABC",
              f"dia_local_v1_{good}_{body}_ABCD", None]
    assert column(spark, values, delivery.key_prefix) == [good, good, None, None, None]


def test_parse_metadata(spark):
    got = column(spark, [None, "", '{"a":1}', "{}", " { } ", "{bad", "[]", "[1]"], delivery.parse_metadata)
    assert [(r.metadata, r.error is not None) for r in got] == [
        ("{}", False), ("{}", False), ('{"a":1}', False), (None, True), (None, True), (None, True), (None, True), ("[1]", False)]


def test_properties(spark):
    kind = ("s struct<name:string,n:int,ok:boolean,d:date,amount:decimal(10,2),inner:struct<a:int>,"
            "items:array<struct<a:int>>,tags:array<string>,m:map<string,string>>")
    row = (("x", 0, False, dt.date(2024, 1, 2), None, (1,), [(2,)], ["t"], {"k": "v"}),)
    df = spark.createDataFrame([row], kind)
    made = properties.to_properties(F.col("s"), df.schema["s"].dataType)
    got = {p.name: (p.value, p.type) for p in df.select(made.alias("p")).first().p}
    assert got["name"] == ("x", "string") and got["n"] == ("0", "number") and got["ok"] == ("false", "boolean")
    assert got["d"] == ("2024-01-02", "date") and got["amount"] == (None, "number")
    assert got["inner"] == ('[{"name":"a","value":"1","type":"number"}]', "object")
    assert got["items"][1] == "list" and '"item"' in got["items"][0]
    assert got["tags"] == ('["t"]', "list") and got["m"][1] == "object"
    kept = df.select(properties.truthy_properties(made).alias("p")).first().p
    assert [p.name for p in kept] == ["name", "d", "inner", "items", "tags", "m"]
    with pytest.raises(TypeError):
        properties.to_properties(F.col("s"), T.StructType([T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))]))


def test_typed_extraction(spark):
    rows = [("cni", '{"nom":"A","x":1,"prenom":null}'), ("autre", '{"x":1}'), ("cni", "{bad"), ("zzz", '{"x":1}'),
            ("visale_certificate", '{"beneficiaires":[{"nom":"B"}]}')]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string")
    got = [r[0] for r in df.orderBy("i").select(properties.typed_extraction("t", "p")).collect()]
    assert got == ['{"nom":"A"}', '{"x":1}', "{bad", '{"x":1}', '{"beneficiaires":[{"nom":"B"}]}']


def test_headers(spark):
    h = {"Authorization": "x", "COOKIE": "y", "Accept": "z"}
    assert column(spark, [h], protect.drop_sensitive_headers, "map<string,string>") == [{"Accept": "z"}]
    merged = column(spark, [{"Content-Type": "a", "X": "b"}, None], protect.merge_headers, "map<string,string>")
    assert merged == [{"X": "b", "Content-Type": "application/json"}, {"Content-Type": "application/json"}]


def test_private_observation(spark):
    raw = ('{"field_scores":{"nom":{"equality":1.0}},"field_details":{"nom":{"expected":"SECRET","predicted":"SECRET",'
           '"metrics":["equality"],"scores":{"equality":1.0}}},"error":null}')
    kept, empty = column(spark, [raw, "{bad"], protect.observation_without_values)
    assert "SECRET" not in kept and '"metrics":["equality"]' in kept and empty == '{"field_scores":{}}'
