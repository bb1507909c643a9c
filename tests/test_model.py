import numpy as np
import pytest

from veloscore.session import scratch_path
from veloscore.sources.model_table import (Model, demo_scalar_model, demo_vector_model,
                                           load_model, publish_model)


def test_demo_models_shape():
    m = demo_scalar_model()
    assert (m.n_inputs, m.n_outputs, m.n_weights) == (1, 1, 6)
    v = demo_vector_model()
    assert (v.n_inputs, v.n_outputs) == (64, 1)
    assert all(float(w * 64).is_integer() for w in v.layers[0].weights[0])


def test_publish_and_load_roundtrip(spark):
    m = demo_scalar_model()
    path = publish_model(m, scratch_path(spark, "t-model"), spark)
    back = load_model(spark, path)
    assert back.model_id == m.model_id
    for a, b in zip(m.layers, back.layers):
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)
        assert a.activation == b.activation


def test_publish_never_overwrites(spark):
    path = publish_model(demo_scalar_model(), scratch_path(spark, "t-model"), spark)
    with pytest.raises(Exception):
        publish_model(demo_scalar_model(), path, spark)


def test_load_picks_model_id_and_checks_size(spark):
    rows = demo_scalar_model().rows() + demo_vector_model().rows()
    df = spark.createDataFrame(rows, "model_id STRING, layer INT, unit INT, weights ARRAY<DOUBLE>, "
                                     "bias DOUBLE, activation STRING")
    assert load_model(spark, df, "demo-64-1").n_inputs == 64
    with pytest.raises(ValueError, match="pass model_id"):
        load_model(spark, df)
    with pytest.raises(ValueError, match="over the limit"):
        load_model(spark, df, "demo-64-1", max_weights=10)
    with pytest.raises(ValueError, match="not found"):
        load_model(spark, df, "nope")


def test_validation_rejects_bad_networks():
    with pytest.raises(ValueError):
        Model.build("x", [([[1.0]], [0.0], "relu"), ([[1.0, 2.0]], [0.0], "linear")])
    with pytest.raises(ValueError, match="activation"):
        Model.build("x", [([[1.0]], [0.0], "softplus")])
    with pytest.raises(ValueError, match="ragged"):
        Model.from_rows("x", [{"layer": 0, "unit": 0, "weights": [1.0], "bias": 0.0,
                               "activation": "relu"},
                              {"layer": 0, "unit": 1, "weights": [1.0, 2.0], "bias": 0.0,
                               "activation": "relu"}])


def test_forward_matches_hand_computation():
    m = demo_scalar_model()
    x = np.array([[53.12], [72.32], [0.0]])
    y = m.forward(x)[:, 0]
    h = np.maximum(0, x * np.array([0.5, -0.25, 0.75]) + np.array([1.5, 20.0, -3.0]))
    assert np.allclose(y, h @ np.array([0.5, 0.125, 0.75]) - 0.5)
    assert round(y[0], 6) == 42.0 and round(y[1], 6) == 57.0
