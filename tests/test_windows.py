from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from seqwatch.functions import sequences
from seqwatch.operators import windows

SCHEMA = "id bigint, us bigint, set_t double, v_t double, series string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("timestamp", F.timestamp_micros("us"))


def seconds(spark, times):
    return frame(spark, [(i, t * 1_000_000, float(i), -float(i), "a") for i, t in enumerate(times)])


def result(df):
    keys = [c for c in df.columns if c == "series"]
    rows = df.select(
        *keys, F.unix_micros("window.start"), F.unix_micros("window.end"), "features"
    ).collect()
    return sorted([*r[:-1], [tuple(x) for x in r[-1]]] for r in rows)


def random_rows(seed):
    """Bursts, gaps longer than a window, equal times, times before 1970."""
    rng = random.Random(seed)
    t, rows = -30_000_000, []
    for i in range(400):
        t += rng.choice([0, 0, 1, 300_000, 1_000_000, 2_500_000, 45_000_000][: rng.randint(2, 7)])
        channel = None if rng.random() < 0.03 else rng.random()
        rows.append((i, t, rng.random(), channel, rng.choice("aab")))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(
    "window, slide, steps",
    [(20, 1, 20), (20, 1, 5), (6, 4, 3), (10, 10, 20), (3.5, 0.5, 4)],
)
def test_same_as_grouping_by_window(spark, seed, window, slide, steps):
    df = frame(spark, random_rows(seed))
    how = dict(
        tie_cols=["id"],
        series_keys=["series"],
        window=timedelta(seconds=window),
        slide=timedelta(seconds=slide),
        steps=steps,
    )
    by_pane = windows.sliding_sequences(df, panes_per_chunk=64, **how)
    want = result(windows.grouped_sequences(df, **how))
    assert result(by_pane) == want
    assert any(not w[-1] for w in want) or seed  # windows all of whose points were skipped
    assert result(windows.grouped_sequences(df, burst_slots=3, **how)) == want


@pytest.mark.parametrize("panes_per_chunk", [20, 21, 1000])
def test_chunk_size_does_not_matter(spark, panes_per_chunk):
    df = frame(spark, random_rows(9))
    how = dict(tie_cols=["id"], panes_per_chunk=panes_per_chunk)
    assert result(windows.sliding_sequences(df, **how)) == result(
        windows.sliding_sequences(df, tie_cols=["id"])
    )


def test_counts_around_the_full_length(spark):
    for n, complete in ((19, 0), (20, 1), (21, 2)):
        got = result(windows.sliding_sequences(seconds(spark, range(100, 100 + n))))
        assert len(got) == n + 19
        assert sum(len(f) == 20 for *_, f in got) == complete


def test_overflow_keeps_all_or_fails(spark):
    df = seconds(spark, [*range(100, 120), 119])
    full = [f for start, _, f in result(windows.sliding_sequences(df, tie_cols=["id"]))
            if start == 100_000_000]
    assert full == [[(float(i), -float(i)) for i in range(21)]]
    with pytest.raises(Exception, match="more than 20 points"):
        windows.sliding_sequences(df, on_overflow="error").collect()
    with pytest.raises(Exception, match="more than 20 points"):
        windows.grouped_sequences(df, on_overflow="error", burst_slots=3).collect()
    fitting = seconds(spark, range(100, 140))
    assert result(windows.sliding_sequences(fitting, on_overflow="error")) == result(
        windows.sliding_sequences(fitting)
    )


def test_one_second_with_a_third_of_all_rows(spark):
    df = spark.range(60_000).select(
        "id",
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 5_000).otherwise(F.col("id"))).alias(
            "timestamp"
        ),
        F.col("id").cast("double").alias("set_t"),
        (-F.col("id")).cast("double").alias("v_t"),
    )
    found = windows.sliding_sequences(df, tie_cols=["id"])
    sizes = found.select(F.unix_seconds("window.end").alias("end"), F.size("features").alias("n"))
    want = windows.grouped_sequences(df, tie_cols=["id"]).select(
        F.unix_seconds("window.end").alias("end"), F.size("features").alias("n")
    )
    assert sizes.exceptAll(want).count() == 0 == want.exceptAll(sizes).count()
    hit = found.filter(F.unix_seconds("window.end") == 5_001).first()
    burst = [x[0] for x in hit.features if x[0] % 3 == 0]
    assert burst == [3.0 * k for k in range(20_000)]
    with pytest.raises(Exception, match="more than 20 points"):
        windows.sliding_sequences(df, tie_cols=["id"], on_overflow="error").collect()


def test_empty_input(spark):
    assert result(windows.sliding_sequences(seconds(spark, [0]).filter("id < 0"))) == []


def test_ordered_sequence_skips_nulls_and_empty_groups(spark):
    df = spark.createDataFrame(
        [("a", 2, 1.0, 1.0), ("a", 1, 2.0, 2.0), ("a", 3, None, 1.0), ("b", 1, None, None)],
        "g string, t int, set_t double, v_t double",
    )
    got = df.groupBy("g").agg(sequences.ordered_sequence(["t"], ["set_t", "v_t"]).alias("s"))
    assert {r.g: r.s for r in got.collect()} == {"a": [[2.0, 2.0], [1.0, 1.0]], "b": []}


def test_ordered_vectors(spark):
    df = spark.createDataFrame(
        [([2.0, 5.0, 6.0],), ([1.0, 3.0, 4.0],), (None,)], "v array<double>"
    )
    got = df.agg(sequences.ordered_vectors(F.col("v")).alias("s")).first().s
    assert got == [[3.0, 4.0], [5.0, 6.0]]


def test_vectors_as_grouped_by_window(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), [float(rng.choice([0, 1, 2, 40, 41, 90])), rng.random(), rng.random()]) for _ in range(80)]
    df = spark.createDataFrame(data, "series string, v array<double>").withColumn(
        "timestamp", F.timestamp_seconds(F.col("v")[0])
    )
    want = df.groupBy("series", F.window("timestamp", "20 seconds", "1 second")).agg(
        sequences.ordered_vectors(F.col("v")).alias("features")
    )
    got = windows.sliding_vectors(df, "v", series_keys=["series"])
    assert result(got) == result(want) != []


def test_reshape_and_shape_text(spark):
    seq = [[float(t), float(-t)] for t in range(20)]
    df = spark.createDataFrame([(seq,)], "s array<array<double>>")
    got = df.select(
        sequences.unflat(sequences.flat(F.col("s")), 20, 2).alias("again"),
        sequences.shape_text(F.col("s")).alias("before"),
        sequences.shape_text(F.col("s"), batched=True).alias("after"),
        F.size(sequences.flat(F.col("s"))).alias("n"),
    ).first()
    assert (got.again, got.before, got.after, got.n) == (seq, "(20, 2)", "(1, 20, 2)", 40)


def test_bad_arguments(spark):
    df = seconds(spark, [0])
    with pytest.raises(ValueError):
        windows.sliding_sequences(df, on_overflow="latest")
    with pytest.raises(ValueError):
        windows.sliding_sequences(df, panes_per_chunk=5)


def test_plan_prunes_before_the_shuffle(spark):
    df = seconds(spark, range(50))
    plan = windows.sliding_sequences(df, on_overflow="error")._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert plan.rindex("WindowGroupLimit") > first_exchange
    assert "Expand" not in plan and "Python" not in plan
    assert plan.count("Exchange ") == 2
