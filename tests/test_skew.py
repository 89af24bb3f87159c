"""Joins whose heavy keys are dealt into cells."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventmill.plans import components, skew


@pytest.mark.parametrize("easy", [0, 10**9])
def test_heavy_keys_join_like_others(spark, monkeypatch, easy):
    monkeypatch.setattr(skew, "EASY", easy)
    many = [(1, k) for k in range(300)] + [(k % 40, 1000 + k) for k in range(200)] + [(None, 5)] * 50
    df = spark.createDataFrame(many, "k int, v int")
    one = spark.createDataFrame([(k, f"n{k}") for k in range(30)] + [(None, "none")], "k int, name string")
    got = Counter(tuple(r) for r in skew.skew_join(df, one, ["k"], F.col("v")).select("k", "v", "name").collect())
    assert got == Counter((k, v, f"n{k}") for k, v in many if k is not None and k < 30)
    semi = skew.skew_join(df, one, ["k"], F.col("v"), "left_semi")
    assert semi.count() == sum(k is not None and k < 30 for k, _ in many)
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    heavy = skew.heavy_keys(counts, ["k"], "n", len(many))
    assert (heavy is None) == (easy > 0) and (heavy is None or max(heavy.values()) > 4)


def test_components_with_a_star(spark, monkeypatch):
    monkeypatch.setattr(skew, "EASY", 0)
    edges = [(0, k) for k in range(1, 200)] + [(300 + k, 301 + k) for k in range(20)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(200)} | {300 + k: 300 for k in range(21)}


def test_only_heavy_keys_are_repeated(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(None).cast("long")).when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    one = spark.range(3000).select(F.when(F.col("id") == 0, F.lit(None).cast("long")).otherwise(F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    key = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    for how in ("inner", "left", "left_anti"):
        got = skew.join_by_cells(many, one, ["k"], F.col("r"), {key: 5}, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, ["k"], how).collect()))
    plan = skew.join_by_cells(many, one, ["k"], F.col("r"), {key: 5})._jdf.queryExecution().optimizedPlan().toString()
    assert "> 1" in plan[plan.index("Generate") :]  # the light keys' rows pass no explode
