import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import SF_MID
from veloscore.functions.activations import ACTIVATIONS
from veloscore.functions.columns import to_int
from veloscore.operators.features import split_features, tag_key
from veloscore.operators.scoring import score, score_batched, score_native
from veloscore.sources.model_table import Model, demo_scalar_model, demo_vector_model

ROUTES = ["native", "udf"]


def _scalar(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id BIGINT, features DOUBLE")


@pytest.mark.parametrize("route", ROUTES)
def test_null_and_nan_features_give_null(spark, route):
    out = score(_scalar(spark, [None, float("nan"), 1.0]), demo_scalar_model(), route=route)
    got = dict((r[0], r[1]) for r in out.select("id", "prediction").collect())
    assert got[0] is None and got[1] is None and got[2] is not None


@pytest.mark.parametrize("route", ROUTES)
def test_truncation_boundary(spark, route):
    out = score(_scalar(spark, [53.12, 72.32]), demo_scalar_model(), route=route)
    got = [r[0] for r in out.orderBy("id").select(to_int("prediction")).collect()]
    assert got == [42, 57]


def test_to_int_edges(spark):
    df = spark.createDataFrame([(-3.99,), (1e12,), (float("nan"),), (41.99999999999999,)], "p DOUBLE")
    got = [tuple(r) for r in df.select(to_int("p"), "p").collect()]
    assert [g[0] for g in got] == [-3, None, None, 42]
    assert got[1][1] == 1e12  # the double is kept beside the NULL integer


@pytest.mark.parametrize("route", ROUTES)
def test_vector_nulls_and_ragged(spark, route):
    m = Model.build("v2", [([[0.5, 0.25]], [1.0], "linear")])
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0])],
                               "id BIGINT, features ARRAY<DOUBLE>")
    got = dict(score(df, m, route=route).select("id", "prediction").collect())
    assert got == {0: 2.0, 1: None, 2: None, 3: None}
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "id BIGINT, features ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="width"):
        score(ragged, m, route=route).collect()
    ragged_nan = spark.createDataFrame([(0, [float("nan")])], "id BIGINT, features ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="width"):
        score(ragged_nan, m, route=route).collect()


def test_scalar_column_needs_one_input_model(spark):
    with pytest.raises(ValueError):
        score_native(_scalar(spark, [1.0]), demo_vector_model())


@pytest.mark.parametrize("acts", [["relu", "sigmoid", "tanh"], ["tanh", "linear", "sigmoid"]])
def test_routes_agree_on_mixed_activations_and_multi_output(spark, acts):
    rng = np.random.default_rng(3)
    m = Model.build("mix", [
        (rng.normal(size=(3, 4)).tolist(), rng.normal(size=3).tolist(), acts),
        (rng.normal(size=(2, 3)).tolist(), rng.normal(size=2).tolist(), "linear"),
    ])
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id BIGINT, features ARRAY<DOUBLE>")
    a = dict(score(df, m, route="udf").select("id", "prediction").collect())
    b = dict(score(df, m, route="native").select("id", "prediction").collect())
    x = np.array([r[1] for r in rows])
    exp = m.forward(x)
    for i in range(40):
        assert np.allclose(a[i], exp[i], atol=1e-12) and np.allclose(b[i], exp[i], atol=1e-12)


def test_wide_layer_uses_array_functions_and_agrees(spark):
    rng = np.random.default_rng(5)
    m = Model.build("wide", [(rng.normal(size=(3, 64)).tolist(), [0.1, 0.2, 0.3], "relu"),
                             ([[1.0, -1.0, 0.5]], [0.0], "linear")])
    emb = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    narrow = score_native(emb, m, "embedding", unroll_limit=10_000).select("vec_id", "prediction")
    wide = score_native(emb, m, "embedding", unroll_limit=16).select("vec_id", "prediction")
    a, b = dict(narrow.collect()), dict(wide.collect())
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_batch_sizes_seen_by_predictor(spark):
    """23 rows in 2 partitions with batch size 5: the predictor never sees more than 5 rows."""
    def make_predict_fn():
        def predict(x):
            return np.full(len(x), float(len(x)))
        return predict
    df = _scalar(spark, [float(i) for i in range(23)]).repartition(2)
    out = score_batched(df, demo_scalar_model(), batch_size=5, make_predict_fn=make_predict_fn)
    sizes = [r[0] for r in out.select("prediction").collect()]
    assert len(sizes) == 23 and max(sizes) <= 5


def test_nondeterministic_udf_scores_each_row_once(spark, tmp_path):
    """A filter on the prediction does not make Spark evaluate the predictor twice."""
    acc = spark.sparkContext.accumulator(0)

    def make_predict_fn():
        def predict(x):
            acc.add(len(x))
            return x[:, 0] if x.ndim == 2 else x
        return predict
    df = _scalar(spark, [float(i) for i in range(23)]).repartition(2)
    out = score_batched(df, demo_scalar_model(), make_predict_fn=make_predict_fn)
    assert out.where(F.col("prediction") > 3).count() == 19
    assert acc.value == 23


def test_native_plan_is_one_codegen_stage_without_python(spark):
    df = split_features(spark.read.parquet(f"{SF_MID}/events.parquet").select("event_id", "value"),
                        0, 0)
    plan = score_native(tag_key(df), demo_scalar_model())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "*(1) Project" in plan  # whole-stage codegen


def test_activations_in_sql_match_numpy(spark):
    xs = np.array([[-2.5, -0.1, 0.0], [0.7, 3.0, -1.0], [5.0, 5.0, 5.0]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xs)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    for name, a in ACTIVATIONS.items():
        if a.wide:
            out = df
            steps = a.steps(["a", "b", "c"], "w")
            for step in steps:
                out = out.select("*", *[F.expr(e).alias(n) for n, e in step])
            got = out.orderBy("id").select([n for n, _ in steps[-1]]).collect()
        else:
            got = df.orderBy("id").select(*[F.expr(a.unit(c)) for c in "abc"]).collect()
        assert np.allclose(got, a.numpy(xs), atol=1e-15), name


def test_auto_route_and_native_size_guard(spark):
    from veloscore.operators import scoring
    big = Model.build("big", [(np.full((1, scoring.NATIVE_MAX_WEIGHTS + 1), 0.0).tolist(), [1.0],
                               "linear")])
    df = spark.createDataFrame([(0, [0.0] * (scoring.NATIVE_MAX_WEIGHTS + 1))],
                               "id BIGINT, features ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="route 'udf'"):
        score_native(df, big)
    assert score(df, big, route="auto").first()["prediction"] == 1.0


def test_input_filter_reaches_parquet_scan(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet").where(F.col("value") > 10.0)
    df = score(split_features(ev.select("event_id", "value"), 0, 0), demo_scalar_model(), route="udf")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan
