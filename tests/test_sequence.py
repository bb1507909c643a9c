"""M1, recurrent layer: both routes against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloscore.operators.sequence import score_sequence
from veloscore.sources.model_table import publish_model
from veloscore.sources.sequence_model import SequenceModel, demo_sequence_model, load_sequence_model


def _model(inputs=2, hidden=3, seed=4):
    draw = np.random.default_rng(seed)
    return SequenceModel.build("m", draw.normal(size=(3 * hidden, inputs)), draw.normal(size=(3 * hidden, hidden)), draw.normal(size=3 * hidden),
                               [(draw.normal(size=(2, hidden)), [0.5, -0.5], "tanh")])


def _loop(model, rows):
    """rows (id, key, t, x) -> {id: prediction}."""
    out, state = {}, {}
    for i, key, t, x in sorted(rows, key=lambda r: (r[2], r[0])):
        h = state.get(key, np.zeros((1, model.cell.hidden)))
        if x is None or any(v is None or v != v for v in x):
            out[i] = None
            continue
        state[key] = h = model.cell.step(h, np.array([x], float))
        out[i] = model.head.forward(h)[0].tolist()
    return out


def _rows(seed=5, n=300):
    draw = np.random.default_rng(seed)
    keys = [None, "a", "b", "a", "c", "a"]
    rows = [(i, keys[draw.integers(0, 6)], int(draw.integers(0, 100)), draw.normal(size=2).tolist()) for i in range(n)]
    rows[7] = (*rows[7][:3], None)
    rows[8] = (*rows[8][:3], [None, 1.0])
    rows[9] = (*rows[9][:3], [float("nan"), 1.0])
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id INT, k STRING, t INT, x ARRAY<DOUBLE>").withColumn("h", F.lit("extra")).withColumn("steps", F.lit(1)).repartition(4)


@pytest.mark.parametrize("route, chunk", [("native", None), ("native", 7), ("native", 40), ("udf", None)])
def test_equals_a_plain_loop(spark, route, chunk):
    model, rows = _model(), _rows()
    df = _frame(spark, rows)
    out = score_sequence(df, model, ["k"], ["t", "id"], features_col="x", route=route, chunk=None if chunk is None else F.floor(F.col("t") / chunk))
    assert out.columns == [*df.columns, "prediction"]
    got, want = {r["id"]: r["prediction"] for r in out.collect()}, _loop(model, rows)
    assert set(got) == set(want)
    for i in want:
        assert got[i] == (want[i] if want[i] is None else pytest.approx(want[i], abs=1e-12)), i


def test_states_are_carried_between_batches(spark):
    model, rows = _model(), _rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["id"]: r["prediction"] for r in score_sequence(_frame(spark, rows), model, ["k"], ["t", "id"], features_col="x", route="udf").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _loop(model, rows)
    for i in want:
        assert got[i] == (want[i] if want[i] is None else pytest.approx(want[i], abs=1e-12)), i


def test_a_key_may_rest_for_chunks(spark):
    model = demo_sequence_model()
    rows = [(1, "a", 0, [3.0]), (2, "b", 10, [4.0]), (3, "b", 20, [1.0]), (4, "a", 95, [5.0])]
    df = spark.createDataFrame(rows, "id INT, k STRING, t INT, x ARRAY<DOUBLE>")
    got = {r["id"]: r["prediction"] for r in score_sequence(df, model, ["k"], ["t"], features_col="x", chunk=F.floor(F.col("t") / 10)).collect()}
    want = _loop(model, rows)
    assert all(got[i] == pytest.approx(want[i][0], abs=1e-12) for i in want)


def test_no_single_partition(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "user_id", "ts", "value")
    for route in ("native", "udf"):
        out = score_sequence(events, demo_sequence_model(), ["user_id"], ["ts", "event_id"], route=route)
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("route", ["native", "udf"])
def test_empty_and_ragged(spark, route):
    model = _model()
    df = _frame(spark, _rows())
    assert score_sequence(df.limit(0), model, ["k"], ["t"], features_col="x", route=route).collect() == []
    with pytest.raises(Exception, match="width"):
        score_sequence(df.withColumn("x", F.array(F.lit(1.0))), model, ["k"], ["t"], features_col="x", route=route).collect()


def test_model_round_trip_and_checks(spark, tmp_path):
    model = _model()
    path = publish_model(model.to_frame(spark), str(tmp_path / "m"))
    again = load_sequence_model(spark, path, "m")
    assert again.rows() == model.rows()
    with pytest.raises(ValueError):
        load_sequence_model(spark, path, "m", max_weights=3)
    with pytest.raises(ValueError):
        SequenceModel.build("m", [[1.0]] * 3, [[1.0]] * 2, [0.0] * 3, [([[1.0]], [0.0], "linear")])
    with pytest.raises(ValueError):
        SequenceModel.build("m", [[1.0]] * 3, [[1.0]] * 3, [0.0] * 3, [([[1.0, 2.0]], [0.0], "linear")])
