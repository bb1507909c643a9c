"""P1 in full: normalisers and class labels; layer-wide activations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloscore.operators.labels import decode_labels, encode_labels, label_dictionary
from veloscore.operators.normalise import feature_statistics, fit_normaliser
from veloscore.operators.scoring import score
from veloscore.sources.model_table import Model, Normaliser, load_model, publish_model

NAN = float("nan")


def _frame(spark):
    """Features: usual, constant, all null, with nulls and NaN."""
    rows = [(i, [i / 2, 7.0, None, None if i % 3 == 0 else NAN if i % 3 == 1 else float(i)]) for i in range(12)]
    return spark.createDataFrame(rows, "id BIGINT, features ARRAY<DOUBLE>").repartition(4)


@pytest.mark.parametrize("width", [4, None])
def test_statistics_leave_missing_values_out(spark, width):
    rows = feature_statistics(_frame(spark), width=width).orderBy("feature").collect()
    assert [r["n"] for r in rows] == [12, 12, 0, 4]
    x = np.arange(12) / 2
    assert rows[0]["mean"] == pytest.approx(x.mean()) and rows[0]["deviation"] == pytest.approx(x.std())
    assert rows[1]["deviation"] == 0 and rows[2]["mean"] is None and (rows[3]["least"], rows[3]["most"]) == (2.0, 11.0)


def test_constant_and_null_columns(spark):
    s = fit_normaliser(_frame(spark), "standardise", width=4)
    assert s.scale[1] == 0 and s.scale[2] == 0 and s.offset == 0
    m = fit_normaliser(_frame(spark), "minmax", low=-1.0, high=3.0)
    assert m.apply(np.array([[0.0, 7.0, 5.0, 2.0], [5.5, 9.0, 1.0, 11.0]])).tolist() == [[-1.0, -1.0, -1.0, -1.0], [3.0, -1.0, -1.0, 3.0]]


def test_moments_do_not_cancel(spark):
    df = spark.createDataFrame([(1e9 + i % 2,) for i in range(1000)], "features DOUBLE").repartition(5)
    n = fit_normaliser(df)
    assert n.shift[0] == pytest.approx(1e9 + 0.5) and 1 / n.scale[0] == pytest.approx(0.5)


@pytest.mark.parametrize("route", ["native", "udf"])
def test_normaliser_travels_with_its_network(spark, tmp_path, route):
    model = Model.build("m", [([[0.5, -0.25]], [1.0], "linear")])
    fitted = Normaliser("standardise", np.array([2.0, -1.0]), np.array([0.5, 4.0]))
    path = publish_model(model.with_normaliser(fitted), str(tmp_path / "m"), spark)
    loaded = load_model(spark, path)
    assert loaded.normaliser.shift.tolist() == [2.0, -1.0] and loaded.normaliser.kind == "standardise"
    df = spark.createDataFrame([(1, [4.0, 0.0]), (2, None), (3, [None, 1.0])], "id INT, features ARRAY<DOUBLE>")
    got = dict(score(df, loaded, route=route).select("id", "prediction").collect())
    assert got == {1: (4 - 2) * 0.5 * 0.5 - (0 + 1) * 4 * 0.25 + 1, 2: None, 3: None}
    scalar = Model.build("s", [([[2.0]], [0.0], "linear")]).with_normaliser(Normaliser("minmax", np.array([1.0]), np.array([0.25]), -1.0))
    one = spark.createDataFrame([(3.0,)], "features DOUBLE")
    assert score(one, scalar, route=route).first()["prediction"] == 2 * ((3 - 1) * 0.25 - 1)


def test_wide_layers_normalise_alike(spark):
    """A layer over the unroll limit takes the array form."""
    draw = np.random.default_rng(0)
    n = 5000
    model = Model.build("w", [(draw.normal(size=(1, n)), [0.0], "linear")]).with_normaliser(Normaliser("minmax", draw.normal(size=n), draw.uniform(0.5, 2, n), 0.25))
    x = draw.normal(size=n)
    df = spark.createDataFrame([(x.tolist(),)], "features ARRAY<DOUBLE>")
    for route in ("native", "udf"):
        assert score(df, model, route=route).first()["prediction"] == pytest.approx(model.forward(x[None])[0, 0], abs=1e-9)


def test_normaliser_must_fit(spark):
    model = Model.build("m", [([[0.5, -0.25]], [1.0], "linear")])
    for bad in (Normaliser("standardise", np.zeros(3), np.ones(3)), Normaliser("other", np.zeros(2), np.ones(2)), Normaliser("minmax", np.zeros(2), np.array([1.0, np.inf]))):
        with pytest.raises(ValueError):
            model.with_normaliser(bad)
    with pytest.raises(ValueError):
        fit_normaliser(_frame(spark), "other")
    with pytest.raises(ValueError):
        fit_normaliser(_frame(spark).where("id < 0"))


@pytest.mark.parametrize("route", ["native", "udf"])
def test_large_logits_do_not_overflow(spark, route):
    model = Model.build("c", [([[1000.0], [-1000.0], [999.0]], [0.0, 0.0, 0.0], "softmax")])
    df = spark.createDataFrame([(0, 5.0), (1, -5.0), (2, 0.0), (3, None)], "id INT, features DOUBLE")
    got = dict(score(df, model, route=route).select("id", "prediction").collect())
    assert got[0] == pytest.approx([1.0, 0.0, np.exp(-5.0)], rel=0.01) and got[1] == [0.0, 1.0, 0.0]
    assert got[2] == pytest.approx([1 / 3] * 3) and got[3] is None


def test_layer_wide_activations_stand_alone():
    with pytest.raises(ValueError, match="mixes"):
        Model.build("m", [([[1.0], [1.0]], [0.0, 0.0], ["softmax", "linear"])])
    one = Model.build("m", [([[3.0]], [0.0], "softmax")])
    assert one.forward(np.array([[2.0]])).tolist() == [[1.0]]


def _labels(spark):
    return spark.createDataFrame([(1, "pear"), (2, "apple"), (3, None), (4, "fig"), (5, "apple"), (6, "")], "id INT, fruit STRING").withColumn("label", F.lit("x"))


def test_labels_are_numbered_in_order(spark):
    df = _labels(spark)
    d = label_dictionary(df.repartition(3), "fruit")
    assert sorted(map(tuple, d.collect()), key=lambda r: r[1]) == [("", 0), ("apple", 1), ("fig", 2), ("pear", 3)]
    out = encode_labels(df, d, "fruit", one_hot=True)
    assert out.columns == ["id", "fruit", "label", "label_index", "label_one_hot"]
    got = {r["id"]: (r["label_index"], r["label_one_hot"]) for r in out.collect()}
    assert got[2] == got[5] == (1, [0.0, 1.0, 0.0, 0.0]) and got[3] == (None, None)
    back = {r["id"]: r["again"] for r in decode_labels(out, d, "label_index", "again").collect()}
    assert back == {1: "pear", 2: "apple", 3: None, 4: "fig", 5: "apple", 6: ""}


def test_unknown_labels(spark):
    df = _labels(spark)
    d = label_dictionary(df.where("id < 4"), "fruit")
    got = {r["id"]: (r["label_index"], r["label_one_hot"]) for r in encode_labels(df, d, "fruit", one_hot=True).collect()}
    assert got[4] == (None, [0.0, 0.0]) and got[1] == (1, [0.0, 1.0])
    with pytest.raises(Exception, match="unknown label"):
        encode_labels(df, d, "fruit", unknown="error").collect()
    assert encode_labels(df.where("id < 4"), d, "fruit", unknown="error").count() == 3
    none = label_dictionary(df.where("fruit is null"), "fruit")
    assert {r["label_index"] for r in encode_labels(df, none, "fruit", one_hot=True).collect()} == {None}


def test_many_labels_are_never_collected(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 20_000).cast("string").alias("l"))
    d = label_dictionary(df, "l")
    assert d.count() == 20_000 and d.agg(F.max("label_index")).first()[0] == 19_999
    assert encode_labels(df, d, "l").where("label_index is null").count() == 0
    with pytest.raises(ValueError, match="one-hot"):
        encode_labels(df, d, "l", one_hot=True)
