"""Pairs of JSON texts that differ only in the names of their scalars are compared once."""

import json
import random

from pyspark.sql import functions as F

from fieldglass.functions import metrics
from fieldglass.operators import evaluation as E
from fieldglass.workload import scalars
from fieldglass.workload.views import Inputs

DATA = "/root/testdata/sf0.01"

ODD = [
    ('{"a":[12,34]}', '{"a":[34,12,34]}', 1), ('{"a":[12,34]}', '{"a":[34,12,35]}', 0), ('["12"]', "[12]", 0), ('["n2"]', "[12]", 0),
    ("[12]", "[12.0]", 0), ("[1.50]", "[1.5]", 1), ("[1e2,17]", "[17,100.0]", 1), ("[-12,12]", "[12]", 0), ("[-0]", "[0]", 1),
    ("[12345678901234567890,12]", "[12,12345678901234567890]", 1), ("[12345678901234567890]", "[12345678901234567891]", 1),
    ("[1234567890123456789]", "[1234567890123456788]", 0), ('["ab"]', '["\\u0061b"]', 1), ('["a,b]"]', '["a,b]","a,b]"]', 1),
    ('{"ab":"cd"}', '{"ab":"ab"}', 0), ('{"ab" : "cd", "x":15}', '{"x": 15,\n"ab":"cd"}', 1), ('{12:34}', '{ 12:34}', 0),
    ('{"ab":1,"ab":2}', '{"ab":2,"ab":1}', 0), ("[012]", "[12]", 0), ("[12,]", "[12]", 0), ('["ab"12]', '["ab" 12]', 0),
    ('12"ab"', '12 "ab"', 0), ("12 34", "12", 1), ("[12] oops", "[12]", 1), ('[12] "x', "[12]", 1), ('["a\nb"]', '["a\nb" ]', 0),
    ("[\x0112]", "[12]", 0), ("[12\x02]", "[12]", 0), ('["ab', '["ab"', 0), (None, "null", 1), (None, "[]", 0), ("[[12],[13]]", "[[13,12]]", 0),
    ('["xx","yy"]', '["yy","xx"]', 1), ('["' + "é" * 600 + '",15]', '[15,"' + "é" * 600 + '"]', 1), ("[true,15]", "[15,true]", 1), ("[12abc]", "[12 abc]", 0),
]


def _texts(seed):
    """Pairs of made values; some texts are broken, some values copied with one change."""
    pick = random.Random(seed)

    def value(depth):
        kind = pick.randrange(8 if depth else 5)
        if kind < 5:
            return [pick.randrange(-30, 30), pick.choice(["a", "bc", "de", "n3", "", "[12"]), pick.choice([True, None, 10**pick.randrange(20)]),
                    pick.choice([1.0, 12.5, 100.0, 1e-7]), pick.randrange(3)][kind]
        if kind < 7:
            return [value(depth - 1) for _ in range(pick.randrange(4))]
        return {pick.choice(["a", "bc", "k12"]): value(depth - 1) for _ in range(pick.randrange(4))}

    def mixed(v):
        if isinstance(v, list):
            items = [mixed(x) for x in v] + [mixed(x) for x in v if pick.random() < 0.3]
            return pick.sample(items, len(items))
        if isinstance(v, dict):
            return {k: mixed(v[k]) for k in pick.sample(list(v), len(v))}
        return value(0) if pick.random() < 0.02 else v

    def text(v):
        made = json.dumps(v, separators=pick.choice([(",", ":"), (", ", ": "), (" ,", " :")]))
        if pick.random() < 0.1:
            at = pick.randrange(len(made))
            made = made[:at] + pick.choice(["", "1", '"', ",", "]", "x", "-"]) + made[at + 1:]
        return made

    for _ in range(400):
        v = [value(3)]
        yield text(v), text(mixed(v))


def _scored(spark, cases):
    """Scores of cases that are repeated, so that their patterns recur."""
    df = spark.createDataFrame([(i, e, p) for i, (e, p) in enumerate(cases)], "id int, expected string, predicted string")
    scored = E.deep_json_scores(df.crossJoin(spark.range(10).select(F.col("id").alias("copy"))))
    assert scored.columns == ["id", "expected", "predicted", "copy", "score"]
    assert "Join LeftOuter" in scored._jdf.queryExecution().optimizedPlan().toString()
    rows = scored.select("id", "score").collect()
    assert len(rows) == 10 * len(cases)
    got = {}
    for row in rows:
        assert got.setdefault(row.id, row.score) == row.score
    return df, [got[i] for i in range(len(cases))]


def test_odd_texts(spark):
    _, got = _scored(spark, [(e, p) for e, p, _ in ODD])
    assert [(e, p, score) for (e, p, _), score in zip(ODD, got)] == ODD


def test_patterns_score_like_their_pairs(spark):
    df, got = _scored(spark, list(_texts(7)))
    alone = df.select("id", metrics.compare_deep_json("expected", "predicted", 6).alias("s")).orderBy("id").collect()
    assert got == [r.s for r in alone]
    assert 50 < sum(got) < 350


def test_pairs_of_one_pattern_are_compared_once(spark):
    pairs = spark.range(5000).select(
        "id", F.format_string('{"k":[%d,%d]}', F.col("id") + 100, F.col("id") + 200).alias("e"),
        F.format_string('{"k":[%d,%d]}', F.col("id") + 200, F.when(F.col("id") % 2 == 0, F.col("id") + 100).otherwise(7)).alias("p"))
    assert pairs.select(metrics.json_pattern("e", "p")).distinct().count() == 2
    scored = E.deep_json_scores(pairs, "e", "p", keep=["id"])
    assert scored.columns == ["id", "score"]
    assert "regexp" not in scored._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert "Join LeftOuter" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.filter((F.col("id") % 2 == 0) != (F.col("score") == 1.0)).count() == 0


def test_pairs_that_all_differ_are_compared_in_their_row(spark):
    pairs = spark.range(300).select("id", F.to_json(F.struct(F.sequence(F.lit(10), F.col("id") + 10).alias("k"))).alias("e"))
    scored = E.deep_json_scores(pairs.withColumn("p", F.replace("e", F.lit("[10"), F.lit("[10,10"))), "e", "p")
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.filter("score = 1.0").count() == 300


def test_query_looks_scores_up(spark):
    plan = scalars.deep_compare_nested(Inputs(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan


def test_no_pairs(spark):
    none = spark.createDataFrame([], "id int, e string, p string")
    assert E.deep_json_scores(none, "e", "p", keep=["id"]).collect() == E.deep_json_scores(none, "e", "p").collect() == []


def test_kept_columns_with_and_without_odd_pairs(spark):
    rows = [(i, f"[{i},{i + 50}]", f"[{i + 50},{i},{i}]") for i in range(10, 40)] + [(1, "[12]", "[12]"), (2, None, None)]
    for odd in ([], [(3, '["\\u0061"]', '["a","a"]')]):
        df = spark.createDataFrame(rows + odd, "id int, e string, p string")
        scored = E.deep_json_scores(df, "e", "p", keep=["id"])
        assert "Join LeftOuter" in scored._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in scored.collect()) == sorted((r[0], 1.0) for r in rows + odd)
