from __future__ import annotations

from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.checks import queries
from seqwatch.operators import models, rows, scoring
from seqwatch.plans import detector as det, scoring as plan
from seqwatch.sinks import messages, tables
from seqwatch.sources import files

SEQ = "id bigint, features array<array<double>>"


def windows_of(spark, *sequences):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], SEQ)
    start = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))
    end = F.timestamp_seconds(F.lit(1_704_067_220) + F.col("id"))
    return df.withColumn("window", F.struct(start.alias("start"), end.alias("end")))


def steps(n, high=1.0):
    return [[high * (t % 2), 0.5] for t in range(n)]


def test_mean_error(spark):
    df = models.WindowMean().reconstruct(windows_of(spark, steps(20), steps(20, 0.2)))
    got = scoring.add_errors(df).orderBy("id").collect()
    assert [(r.mae_set_t, r.mae_v_t) for r in got] == [(0.5, 0.0), (0.1, 0.0)]
    assert got[0].prediction == [[0.5, 0.5]] * 20


def test_equal_to_threshold_is_no_anomaly(spark):
    scored = scoring.score(windows_of(spark, steps(20), steps(20, 1.01)), models.WindowMean(), [0.5, 0.0])
    assert {r.id: r.isAnomaly for r in scored.collect()} == {0: False, 1: True}


def test_any_channel_flags(spark):
    scored = scoring.score(windows_of(spark, steps(20)), models.WindowMean(), [0.9, -0.1])
    assert scored.first().isAnomaly


def test_incomplete_windows(spark):
    df = windows_of(spark, steps(20), steps(19), [])
    assert scoring.score(df, models.WindowMean(), [0.1, 0.2]).count() == 1
    kept = scoring.score(df, models.WindowMean(), [0.1, 0.2], keep_incomplete=True)
    rest = kept.filter("id > 0").collect()
    assert [(r.isAnomaly, r.mae_set_t, r.prediction) for r in rest] == [(None, None, None)] * 2
    assert [(r.threshold_set_t, r.threshold_v_t) for r in rest] == [(0.1, 0.2)] * 2
    assert scoring.drop_unscored(kept).count() == 1


def test_pack_and_unpack(spark):
    kept = scoring.score(
        windows_of(spark, steps(20), steps(3)), models.WindowMean(), [0.1, 0.2], keep_incomplete=True
    )
    packed = scoring.as_score_struct(kept)
    assert packed.select("predictions.*").columns == [
        "isAnomaly", "threshold_set_t", "threshold_v_t", "mae_set_t", "mae_v_t", "prediction"
    ]
    flat = scoring.unpack_scores(packed, carry=["id"]).collect()
    assert [(r.id, r.window_end, r.mae_set_t) for r in flat] == [
        (0, datetime(2024, 1, 1, 0, 0, 20), 0.5)
    ]


def test_threshold_frame_and_literals_agree(spark, tmp_path):
    df = windows_of(spark, steps(20), steps(20, 0.3))
    errors = scoring.add_errors(models.WindowMean().reconstruct(df))
    tables.write_threshold(scoring.fit_threshold(errors), str(tmp_path / "thr"))
    stored = files.read_threshold(spark, str(tmp_path / "thr"))
    assert stored.first().mae_threshold == [0.5, 0.0]
    by_frame = scoring.judge(errors, stored).drop("window").collect()
    assert by_frame == scoring.judge(errors, [0.5, 0.0]).drop("window").collect()
    plan_text = scoring.judge(errors, stored)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan_text and "Cartesian" not in plan_text


def test_float32(spark):
    df = windows_of(spark, [[0.1, 0.2]] * 20)
    got = scoring.score(df, models.WindowMean(), [1, 1], float32=True).first()
    assert got.features[0] == [float(np.float32(0.1)), float(np.float32(0.2))]


def test_batch_model_sees_batches_of_sequences(spark):
    def make():
        def predict(x):
            assert x.ndim == 3 and x.shape[1:] == (20, 2)
            return x[:, ::-1, :]

        return predict

    seq = [[float(t), 10.0 * t] for t in range(20)]
    got = models.BatchModel(make).reconstruct(windows_of(spark, seq, seq)).collect()
    assert [r.prediction for r in got] == [seq[::-1]] * 2


def test_manual_check_input(spark):
    """The constant block used to try a served model by hand."""
    block = [[0.45, 0.66], [0.45, 0.57]] * 10
    got = scoring.score(windows_of(spark, block), models.WindowMean(), [0.0, 0.05]).first()
    assert (got.mae_set_t, got.mae_v_t, got.isAnomaly) == (0.0, 0.045, False)


@pytest.fixture(scope="module")
def history(spark):
    return spark.range(0, 600, 1, 4).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("timestamp"),
        (20 + F.floor(F.col("id") / 60) % 7).cast("float").alias("set_t"),
        (20 + F.sin(F.col("id") / 5) * 3 + F.rand(1)).cast("float").alias("v_t"),
    ).cache()


def test_pca_is_no_worse_than_the_mean(spark, history):
    training = rows.row_sequences(history, flat=False, carry=["timestamp"])
    model = models.PcaReconstruction.fit(training, 6)
    ordered = model.reconstruct(training).orderBy("timestamp").collect()
    again = np.array([np.ravel(r.prediction) for r in ordered])
    source = np.array([np.ravel(r.features) for r in ordered])
    again_want = model.center + (source - model.center) @ model.components @ model.components.T
    assert np.allclose(again, again_want)
    assert ((again - source) ** 2).sum() <= ((source - model.center) ** 2).sum()
    full = models.PcaReconstruction.fit(training, 40)
    exact = np.array([np.ravel(r.prediction) for r in full.reconstruct(training).orderBy("timestamp").collect()])
    assert np.allclose(exact, source, atol=1e-8)


def test_detector_survives_save_and_load(spark, history, tmp_path):
    fitted = det.fit_detector(history, det.pca(4))
    fitted.save(spark, str(tmp_path / "d"))
    loaded = det.Detector.load(spark, str(tmp_path / "d"))
    assert (loaded.scaler, loaded.threshold) == (fitted.scaler, fitted.threshold)
    scored = plan.score_readings(history, loaded)
    assert scored.count() == 581
    # Dense history: its windows are the training sequences, so none exceeds their maximum.
    assert scored.filter("isAnomaly").count() == 0


def test_saving_again_replaces_the_model(spark, history, tmp_path):
    path = str(tmp_path / "d")
    det.fit_detector(history, det.pca(4)).save(spark, path)
    det.fit_detector(history, det.window_mean).save(spark, path)
    assert det.Detector.load(spark, path).model == models.WindowMean()


def test_a_users_model_is_loaded_by_the_user(spark, history, tmp_path):
    path = str(tmp_path / "d")
    own = models.BatchModel(lambda: lambda x: x * 0.9)
    det.fit_detector(history, lambda _training: own).save(spark, path)
    with pytest.raises(ValueError, match="load_model"):
        det.Detector.load(spark, path)
    assert det.Detector.load(spark, path, lambda *_: own).model is own


def test_fitted_detector_finds_a_jump(spark, history):
    fitted = det.fit_detector(history, det.window_mean)
    jumped = history.withColumn(
        "v_t",
        F.when(F.unix_seconds("timestamp") >= 1_704_067_500, F.col("v_t") + 500).otherwise(F.col("v_t")),
    )
    flagged = plan.flatten_window(plan.score_readings(jumped, fitted)).filter("isAnomaly")
    ends = sorted(r[0] for r in flagged.select(F.unix_seconds("window_end")).collect())
    assert ends == list(range(1_704_067_501, 1_704_067_520))


def test_messages(spark):
    scored = scoring.score(windows_of(spark, steps(20)), models.WindowMean(), [0.1, 0.2])
    sent = messages.prediction_messages(plan.flatten_window(scored)).first()
    assert sent.key == "2024-01-01 00:00:20"
    assert sent.value.startswith(
        '{"window_start":"2024-01-01T00:00:00.000Z","window_end":"2024-01-01T00:00:20.000Z",'
        '"event_timestamp":1704067220,"isAnomaly":true,"mae_set_t":0.5,"mae_v_t":0.0,'
        '"threshold_set_t":0.1,"threshold_v_t":0.2,"features":[[0.0,0.5],[1.0,0.5],'
    )
    nested = messages.nested_prediction_messages(scored)
    assert nested.columns == ["value", "key"]
    assert "event_timestamp" not in nested.first().value
    shapes = plan.window_shapes(windows_of(spark, steps(20), steps(2)), [0.1, 0.2])
    (diagnosis,) = messages.diagnostic_messages(shapes).collect()
    assert diagnosis.value.endswith(
        '"shape_before":"(20, 2)","shape_after":"(1, 20, 2)",'
        '"threshold_set_t":0.1,"threshold_v_t":0.2}'
    )


def test_messages_omit_nulls(spark):
    kept = scoring.score(windows_of(spark, steps(2)), models.WindowMean(), [0.1, 0.2], keep_incomplete=True)
    value = messages.prediction_messages(plan.flatten_window(kept)).first().value
    assert "isAnomaly" not in value and "mae_" not in value and "threshold_v_t" in value


def test_preview(spark):
    schema, first = tables.preview(spark.range(5).orderBy(F.desc("id")), ["id"])
    assert schema.names == ["id"] and [r.id for r in first.collect()] == [0, 1]


def test_model_runs_once_per_window(spark, history):
    fitted = det.fit_detector(history, det.pca(2))
    scored = scoring.unpack_scores(scoring.as_score_struct(plan.score_readings(history, fitted)))
    text = scored._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_pca_is_numpys_on_the_same_sequences(spark, history):
    training = rows.row_sequences(history, flat=False)
    source = np.array([np.ravel(r.features) for r in training.collect()])
    count, total, products = models.moments(training.repartition(7), 40)
    assert count == len(source)
    assert np.allclose(total, source.sum(axis=0)) and np.allclose(products, source.T @ source)
    _, _, right = np.linalg.svd(source - source.mean(axis=0), full_matrices=False)
    for k in (1, 3):
        model = models.PcaReconstruction.fit(training, k)
        assert np.allclose(model.components @ model.components.T, right[:k].T @ right[:k], atol=1e-8)
    with pytest.raises(ValueError, match="no training"):
        models.PcaReconstruction.fit(training.limit(0), 2)


def total_error(found: list, model) -> float:
    x = np.array([r.features for r in found]).reshape(len(found), -1)
    y = (x - model.center) @ model.encoder @ model.decoder[:-1] + model.decoder[-1]
    return np.abs(x - y).sum()


def plain_rounds(x, center, encoder, rounds):
    """The same reweighting value by value, with weighted least squares from NumPy."""
    code = np.hstack([(x - center) @ encoder, np.ones((len(x), 1))])
    decoder = np.vstack([encoder.T, center])
    tried = [decoder]
    for _ in range(rounds):
        error = np.abs(x - code @ decoder)
        columns = []
        for j in range(x.shape[1]):
            root = 1 / np.sqrt(np.maximum(error[:, j], models.LEAST_ERROR))
            columns.append(np.linalg.lstsq(code * root[:, None], x[:, j] * root)[0])
        decoder = np.stack(columns, axis=1)
        tried.append(decoder)
    return min(tried, key=lambda d: np.abs(x - code @ d).sum())


def test_absolute_error_is_least_and_numpys(spark, history):
    """Jumps in one row of fifty pull principal components; the decoder under absolute error resists."""
    jump = F.when(F.rand(3) < 0.02, 40.0).otherwise(0.0)
    training = rows.row_sequences(
        history.withColumn("v_t", F.col("v_t") + jump), flat=False
    ).select("features").cache()
    found = training.collect()
    x = np.array([r.features for r in found]).reshape(len(found), -1)
    pca = models.PcaReconstruction.fit(training, 3)
    start = models.AbsoluteReconstruction(pca.center, pca.components, np.vstack([pca.components.T, pca.center]))
    model = models.AbsoluteReconstruction.fit(training, 3, rounds=4)
    assert np.allclose(model.encoder, pca.components)
    want = plain_rounds(x, pca.center, pca.components, 4)
    assert np.allclose(model.decoder, want, atol=1e-5)
    assert total_error(found, model) < 0.99 * total_error(found, start)


def test_absolute_model_is_saved_and_its_training_removed(spark, history, tmp_path):
    root = Path(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    fitted = det.fit_detector(history, det.absolute(2, rounds=1))
    fitted.save(spark, f"{tmp_path}/detector")
    again = det.Detector.load(spark, f"{tmp_path}/detector")
    assert np.array_equal(again.model.decoder, fitted.model.decoder)
    assert not list(Path(str(root).removeprefix("file:")).rglob("training-*"))
    assert plan.score_readings(history, again).filter("isAnomaly").count() == 0


def test_absolute_model_needs_sequences(spark, history):
    with pytest.raises(ValueError, match="no training sequences"):
        det.fit_detector(history.limit(5), det.absolute(2))


@pytest.mark.parametrize("name", ["predictions_message", "predictions_message_nested"])
def test_messages_are_parsed_once(spark, small, name):
    plan_text = queries.ALL[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.count("from_json") == 1


def test_only_texts_of_points_are_sorted(spark, small):
    plan_text = queries.ALL["points_unpivot_nested"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.count("Aggregate [") >= 2 and "_svalue" in plan_text.split("Aggregate [")[2].split("]")[0]
