import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm.mixing import draw_plan, systematic_copies

ROW = "s string, id int, e double, tokens int"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0.0, 0.25, 0.5, 1.0, 1.75, 3.0])), min_size=1, max_size=60))
def test_each_row_and_each_stratum_get_what_is_expected(spark, rows):
    df = spark.createDataFrame([(s, i, e, 1) for i, (s, e) in enumerate(rows)], ROW).repartition(3)
    got = {r["id"]: r["copies"] for r in systematic_copies(df, ["s"], "e", [F.col("id")]).collect()}
    for i, (_, e) in enumerate(rows):
        assert math.floor(e) <= got.get(i, 0) <= math.ceil(e)
    for s in {s for s, _ in rows}:
        want = sum(e for t, e in rows if t == s)
        assert abs(sum(got.get(i, 0) for i, (t, _) in enumerate(rows) if t == s) - want) <= 1


def test_odd_expectations_empty_tables_and_large_strata(spark):
    df = spark.createDataFrame([("a", 1, None, 1), ("a", 2, float("nan"), 1), ("a", 3, -2.0, 1), ("a", 4, 2.0, None)], ROW)
    assert [(r["id"], r["copies"]) for r in systematic_copies(df, ["s"], "e", [F.col("id")]).collect()] == [(4, 2)]
    assert systematic_copies(df.where("false"), ["s"], "e", [F.col("id")]).count() == 0
    many = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"), F.col("id").cast("int"), F.lit(0.3).alias("e"), (F.col("id") % 97).cast("int").alias("tokens"))
    drawn = {r["s"]: (r["n"], r["t"]) for r in systematic_copies(many, ["s"], "e", [F.col("tokens"), F.col("id")]).groupBy("s").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("tokens")).alias("t")).collect()}
    for s, rows in (("x", 13_334), ("y", 26_666)):
        assert abs(drawn[s][0] - 0.3 * rows) <= 1 and abs(drawn[s][1] / (0.3 * rows * 48) - 1) < 0.01


def test_plan(spark):
    sizes = spark.createDataFrame([("big", 10, 900), ("small", 2, 50), (None, 1, 50)], "source string, docs bigint, tokens bigint")
    mix = spark.createDataFrame([("m", 1.0)], "mixture string, size_factor double")
    targets = spark.createDataFrame([("m", " Big ", 0.45, 3), ("m", "small", 0.45, 2), ("m", "none", 0.1, 2)], "mixture string, source string, target_share double, max_repeats int")
    got = {r["source"]: (r["wanted_tokens"], r["expected"]) for r in draw_plan(sizes, mix, targets).collect()}
    assert got == {"big": (450.0, 0.5), "small": (450.0, 2.0), "none": (100.0, 0.0)}


def test_over_offsets_a_row_gets_its_expectation(spark):
    """One random offset a stratum: every row's chance is what it expects, whichever rows stand around it."""
    df = spark.createDataFrame([("a", i, [0.2, 0.7, 1.3, 0.05][i % 4], i) for i in range(12)], ROW)
    runs, got = 24, {}
    for seed in range(runs):
        for r in systematic_copies(df, ["s"], "e", [F.col("id")], seed=seed).collect():
            got[r["id"]] = got.get(r["id"], 0) + r["copies"]
    assert all(abs(got.get(i, 0) / runs - [0.2, 0.7, 1.3, 0.05][i % 4]) < 0.35 for i in range(12))
