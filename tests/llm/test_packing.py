import numpy as np
import pytest
from compare import connection, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm.packing import Fit, best_fit, fill_report, items_of, pack, placement_report
from siltworks.llm.queries import oracle_sql, queries
from siltworks.llm.tokens import DEFAULT_VOCABULARY, encoder, token_count


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=700), st.sampled_from(["norm", "dot"]))
def test_every_constraint_holds(sizes, rule):
    sizes = np.array(sorted(sizes, reverse=True))
    fit = Fit(rule=rule, documents_per_token=1 / 8, attention_share=1.0)
    bins = best_fit(sizes, 100, fit)
    used, held = np.bincount(bins, sizes), np.bincount(bins)
    assert len(bins) == len(sizes) and used.max() <= 100 and held.max() <= 12 and np.bincount(bins, sizes.astype(float) ** 2).max() <= 100**2
    half = (used <= 50) & (held <= 6)
    assert half.sum() <= 1  # two such bins would have been one


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_each_capacity_can_be_the_one_that_binds(rule):
    fit = Fit(rule=rule, documents_per_token=1 / 10, least_documents=1, attention_share=0.5)
    held = lambda sizes: np.bincount(best_fit(np.array(sizes), 100, fit)).tolist()
    assert held([1] * 25) == [10, 10, 5]  # documents
    assert held([60, 40, 40]) == [1, 2]  # attention: 60 and 40 have tokens for each other, but cost too much
    assert held([90, 10, 10]) == [1, 2]  # too heavy for it by itself: alone
    assert held([50, 25, 25]) == [3]  # tokens


def test_texts_are_whole_unless_above_the_capacity(spark):
    long = "é word " * 900
    docs = spark.createDataFrame([(1, "short text"), (2, ""), (3, None), (4, long), (5, "same"), (5, "same"), (6, "日本語" * 200)], "doc_id int, text string")
    items = items_of(docs, [("s", 64), ("l", 100_000)]).collect()
    enc = encoder(DEFAULT_VOCABULARY)
    small = [r for r in items if r["container"] == "s"]
    assert sorted({r["doc_id"] for r in small}) == [1, 2, 4, 5, 6] and sum(r["doc_id"] == 5 for r in small) == 2
    for doc, text in ((4, long), (6, "日本語" * 200)):
        ids = enc.encode_ordinary(text)
        pieces = sorted((r["piece"], r["start_token"], r["tokens"]) for r in small if r["doc_id"] == doc)
        assert max(t for *_, t in pieces) <= 64 and sum(t for *_, t in pieces) == len(ids)
        assert "".join(enc.decode_bytes(ids[s : s + t]).decode() for _, s, t in pieces) == text
    assert all(r["piece"] == 0 for r in items if r["container"] == "l")


def test_rounds_fill_the_bins_and_lose_nothing(spark):
    df = spark.range(5000).select(F.lit("c").alias("container"), F.lit(512).alias("capacity"), "id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).cast("int").alias("tokens")).withColumnRenamed("id", "doc_id")
    packed = pack(df, shard_items=400).cache()
    assert packed.count() == 5000 and packed.select("doc_id").distinct().count() == 5000
    r = fill_report(packed).first()
    assert r["fill"] > 0.985 and r["bins"] <= r["least_bins"] * 1.015 + 1
    assert packed.groupBy("bin").agg(F.sum("tokens").alias("t"), F.max("bin_tokens").alias("b")).where("t > 512 OR t <> b").count() == 0
    assert pack(df.where("false")).count() == 0


@pytest.mark.parametrize("text, n", [("", 0), (None, None), ("hello world", 2)])
def test_counts(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(token_count(F.col("t"))).first()[0] == n


def test_placement_report_tells_faults(spark):
    rows = [("c", 64, 1, 0, 0, 60, "b0", 60), ("c", 64, 2, 0, 0, 60, "b0", 60), ("c", 64, 3, 0, 0, 10, "b1", 60), ("c", 64, 3, 1, 10, 10, "b1", 60)]
    packed = spark.createDataFrame(rows, "container string, capacity int, doc_id bigint, piece int, start_token bigint, tokens int, bin string, bin_tokens bigint")
    r = placement_report(packed).first()
    assert (r["documents"], r["badly_cut"], r["overfull_bins"]) == (3, 1, 1)


@pytest.mark.parametrize("name", ["p6_placed", "p7_bounds"])
def test_invariants_equal_their_sql(spark, name):
    same(spark, connection(), queries()[name], oracle_sql()[name])
