from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqwatch.operators import rows


def readings(spark, n, parts=5):
    return spark.range(0, n, 1, parts).select(
        "id",
        F.timestamp_seconds(F.col("id") * 7919 % n).alias("timestamp"),
        (F.col("id") * 7919 % n).cast("double").alias("set_t"),
        (-(F.col("id") * 7919 % n)).cast("double").alias("v_t"),
    )


def firsts(df):
    return sorted(r.features[0] for r in df.collect())


def expected(n, steps=20):
    return [[s * v for t in range(i, i + steps) for v, s in ((t, 1.0), (t, -1.0))]
            for i in range(n - steps + 1)]


def test_row_index_is_dense_and_ordered(spark):
    df = rows.row_index(readings(spark, 1_001), ["timestamp"])
    got = df.select("row_index", F.unix_seconds("timestamp").alias("t")).collect()
    assert sorted((r.row_index, r.t) for r in got) == [(i, i) for i in range(1_001)]


def test_row_index_balances_one_hot_time(spark):
    df = spark.range(30_000).select("id", F.lit(5).alias("t"))
    got = rows.row_index(df, ["t", "id"]).filter("row_index != id").count()
    assert got == 0


@pytest.mark.parametrize("n", [0, 19, 20, 21, 200])
def test_count_law_and_content(spark, n):
    df = readings(spark, max(n, 1)).limit(n)
    got = sorted(r.features for r in rows.row_sequences(df).collect())
    assert got == expected(n)


@pytest.mark.parametrize("chunk_rows", [20, 33, 50, 4096])
def test_chunk_size_does_not_matter(spark, chunk_rows):
    got = rows.row_sequences(readings(spark, 300), chunk_rows=chunk_rows)
    assert sorted(r.features for r in got.collect()) == expected(300)


def test_series_do_not_mix(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("aaab"), float(rng.randint(0, 50))) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, series string, set_t double").withColumns(
        {"timestamp": F.timestamp_seconds("id"), "v_t": F.col("id").cast("double")}
    )
    got = rows.row_sequences(df, series_keys=["series"], carry=["id"], chunk_rows=64).collect()
    want = {}
    for key in "ab":
        own = [(i, x) for i, s, x in data if s == key]
        for k in range(len(own) - 19):
            want[own[k][0]] = (key, [v for i, x in own[k : k + 20] for v in (x, float(i))])
    assert {r.id: (r.series, r.features) for r in got} == want


def test_nested_form(spark):
    flat = rows.row_sequences(readings(spark, 60), carry=["id"])
    nested = rows.row_sequences(readings(spark, 60), carry=["id"], flat=False)
    joined = flat.join(nested.withColumnRenamed("features", "nested"), "id")
    assert joined.filter(F.flatten("nested") == F.col("features")).count() == 41


def test_training_pairs(spark):
    pairs = rows.as_training_pairs(rows.row_sequences(readings(spark, 60)), partitions=3)
    assert pairs.rdd.getNumPartitions() == 3
    assert pairs.filter("features = labels").count() == 41


def test_a_trainers_share_is_read_by_several_tasks(spark):
    sequences = rows.row_sequences(readings(spark, 260), carry=["id"])
    pairs = rows.as_training_pairs(sequences, partitions=2, carry=["id"], tasks=4)
    part = F.spark_partition_id()
    sizes = [r["count"] for r in pairs.groupBy(part.alias("p")).count().collect()]
    trainers = pairs.groupBy((part % 2).alias("trainer")).count().collect()
    assert len(sizes) == 8 and max(sizes) < 241 / 4
    assert all(abs(r["count"] - 241 / 2) < 20 for r in trainers)
    assert pairs.columns == ["id", "features", "labels"]
    assert pairs.filter("features = labels").select("id").distinct().count() == 241


def test_no_task_holds_a_whole_series(spark):
    df = rows.row_sequences(readings(spark, 500), chunk_rows=50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_chunk" in plan and "Python" not in plan


def tied_rows(spark):
    """30,000 rows, a third of them at one key: half of those equal, half told apart by ``v``."""
    row = F.col("id")
    return spark.range(0, 30_000, 1, 7).select(
        F.when(row % 3 == 0, 500).otherwise(row % 1_000).cast("int").alias("t"),
        F.when((row % 3 == 0) & (row % 2 == 0), -1).otherwise(row).cast("long").alias("v"),
    )


@pytest.mark.parametrize("buckets", [2, 8, 50])
def test_a_third_of_all_rows_at_one_key_spreads(spark, buckets, monkeypatch):
    monkeypatch.setattr(rows, "TIED", 100)
    df = tied_rows(spark)
    got = rows.row_index(df, ["t"], buckets=buckets).collect()
    want = sorted((r.t, r.v) for r in df.collect())
    assert [(r.t, r.v) for r in sorted(got, key=lambda r: r.row_index)] == want
    assert sorted(r.row_index for r in got) == list(range(30_000))

    placed, order = rows.dealt(df, ["t"], buckets)
    sizes = [r.n for r in placed.groupBy("_bucket").agg(F.sum("_n").alias("n")).collect()]
    assert order == ["t", "v", "_part"] and sum(sizes) == 30_000
    assert max(sizes) < 2 * 30_000 / buckets


def test_all_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(rows, "TIED", 100)
    df = spark.range(20_000).select(F.lit(1.5).alias("t"), F.lit(None).cast("string").alias("x"))
    placed, _ = rows.dealt(df, ["t"], 8)
    sizes = [r.n for r in placed.groupBy("_bucket").agg(F.sum("_n").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5_000
    got = rows.row_index(df, ["t"], buckets=8)
    assert sorted(r.row_index for r in got.collect()) == list(range(20_000))


def test_rows_of_folded_ones_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(rows, "TIED", 100)
    df = spark.range(20_000).select(F.lit(1.5).alias("t"), F.lit(None).cast("string").alias("x"))
    numbered = rows.row_index(df, ["t"], buckets=8)
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5_000


def test_tied_keys_with_map_columns(spark, monkeypatch):
    monkeypatch.setattr(rows, "TIED", 100)
    df = tied_rows(spark).withColumn("m", F.create_map(F.lit("a"), "v"))
    got = rows.row_index(df, ["t"], buckets=8).collect()
    want = sorted((r.t, r.v) for r in df.collect())
    assert [(r.t, r.v) for r in sorted(got, key=lambda r: r.row_index)] == want
    assert all(r.m == {"a": r.v} for r in got)


def test_no_key_is_split_without_ties(spark, monkeypatch):
    monkeypatch.setattr(rows, "TIED", 2)
    placed, _ = rows.dealt(readings(spark, 2_000), ["timestamp"], 8)
    assert "_part" not in placed.columns
    sizes = [r.n for r in placed.groupBy("_bucket").agg(F.sum("_n").alias("n")).collect()]
    assert sum(sizes) == 2_000 and max(sizes) < 600


def test_sequences_across_a_tied_key(spark, monkeypatch):
    plain = readings(spark, 400).withColumn("timestamp", F.timestamp_seconds(F.floor(F.col("set_t") / 200)))
    want = sorted(r.features for r in rows.row_sequences(plain).collect())
    monkeypatch.setattr(rows, "TIED", 100)
    assert sorted(r.features for r in rows.row_sequences(plain).collect()) == want
    assert len(want) == 381
