import random

import pytest
from compare import connection, same
from pyspark.sql import functions as F

from siltworks.llm import queries as Q
from siltworks.llm.topn import top_n_per_group


def brute(rows, n):
    best = {}
    for r in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None and r[1] == r[1] else float("-inf")), r[2] is not None, r[2] if r[2] is not None else 0, r[3])):
        best.setdefault(r[0], []).append(r[3])
    return {g: ids[:n] for g, ids in best.items()}


@pytest.mark.parametrize("row_group", [50, 1 << 20])
@pytest.mark.parametrize("scores", ["levels", "many"])
def test_equals_a_sort_of_everything(spark, row_group, scores):
    rnd = random.Random(3)
    score = (lambda: rnd.choice([None, 0.0, 1.0, 2.0, 5.0])) if scores == "levels" else (lambda: rnd.choice([None, float("nan"), rnd.random()]))
    rows = [(rnd.choice(["hot"] * 9 + ["a", "b", None, ""]), score(), rnd.choice([None, 1, 2]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, s double, t int, id int").repartition(6)
    got = top_n_per_group(df, [F.col("g")], F.col("s"), [F.col("t"), F.col("id")], n=5, max_waves=4, row_group_rows=row_group).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["g"], []).append(r["id"])
    assert by == brute(rows, 5)


def test_clashing_names_empty_input_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1.0, "x", 9)] * 3, "file string, rank double, `a.b` string, __score int")
    got = top_n_per_group(df, [F.col("file")], F.col("rank"), [F.col("__score")], n=2)
    assert got.columns == ["file", "a.b", "__score", "rank"] and got.count() == 2
    assert top_n_per_group(df.where("false"), [F.col("file")], F.col("__score"), [], n=2).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, [F.col("file")], F.col("__score"), [], n=0)


def test_row_groups_are_skipped(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") % 6).cast("double").alias("s"), "id")
    small = spark.range(20_000).select((F.col("id") % 9000).cast("string").alias("g"), (F.col("id") % 5).cast("double").alias("s"), "id")
    report = []
    got = top_n_per_group(hot.unionByName(small), [F.col("g")], F.col("s"), ["id"], n=3, row_group_rows=2000, report=report)
    assert [r["id"] for r in got.where("g = 'hot'").orderBy("rank").collect()] == [5, 11, 17] and got.count() == 3 + 20_000
    (r,) = report
    assert r["rows"] == 220_000 and r["row_groups"] > 100  # of the large group, those of the first of six scores are read
    assert r["row_groups_read"] < 0.4 * r["row_groups"] and r["rows_read"] < 0.4 * r["rows"] and r["waves"] > 1


def test_a_row_group_of_several_groups_is_skipped_if_all_of_them_are_full(spark):
    """Two groups share the row groups of low scores."""
    rows = [(g, float(9 - i // 40), i) for g in "ab" for i in range(400)]
    df, report = spark.createDataFrame(rows, "g string, s double, id int").coalesce(1), []
    got = top_n_per_group(df, [F.lit(1), F.col("g")], F.col("s"), ["id"], n=2, row_group_rows=150, report=report)
    assert sorted((r["g"], r["id"]) for r in got.collect()) == [(g, i) for g in "ab" for i in (0, 1)]
    assert report[0]["rows_read"] < 800


def test_null_groups(spark):
    df = spark.createDataFrame([(None, "a", 1.0), ("a", None, 2.0), (None, "a", 3.0), (None, None, 4.0)], "x string, y string, s double")
    got = top_n_per_group(df, [F.col("x"), F.col("y")], F.col("s"), [], n=1)
    assert sorted(r["s"] for r in got.collect()) == [2.0, 3.0, 4.0]


def test_registered_query_skips(spark):
    (r,) = Q.queries()["p1_skipping"](spark, "/root/testdata/sf0.1").collect()
    assert 0 < r["row_groups_read"] < r["row_groups"] and r["rows_read"] < 0.98 * r["rows"]


def test_query_equals_its_sql(spark):
    same(spark, connection(), Q.queries()["p1_found"], Q.oracle_sql()["p1_found"])


def test_severities_and_paths(spark):
    df = spark.createDataFrame([(" HIGH ", "./a\\b"), (None, None), ("odd", "..//c"), ("Note", "d")], "s string, f string")
    assert [tuple(r) for r in df.select(Q.severity_rank(F.col("s")), Q.plain_path(F.col("f"))).collect()] == [(4, "a/b"), (0, ""), (0, "c"), (1, "d")]
