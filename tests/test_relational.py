"""M1, third form: joins and sums in place of shipped weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F


from veloscore.operators.relational import score_relational, score_table
from veloscore.operators.scoring import score
from veloscore.sources.model_table import (MODEL_SCHEMA, Model, Normaliser, demo_class_model, demo_scalar_model,
                                           load_model, publish_model)


def _network(seed=1, widths=(7, 5, 4, 3), acts=("tanh", "normalise", "softmax")):
    draw = np.random.default_rng(seed)
    layers = [(draw.normal(size=(n, m)), draw.normal(size=n), a) for m, n, a in zip(widths[:-1], widths[1:], acts, strict=True)]
    return Model.build("random", layers)


def _rows(spark, n=60, width=7, seed=2):
    x = np.random.default_rng(seed).normal(size=(n, width))
    data = [(i, x[i].tolist(), "extra") for i in range(n)]
    data += [(n, None, "extra"), (n + 1, [None] * width, None), (n + 2, [float("nan")] * width, "extra"), (0, x[0].tolist(), "again")]
    return spark.createDataFrame(data, "id BIGINT, features ARRAY<DOUBLE>, h STRING").repartition(3), x


def _values(df):
    return sorted(((r["id"], r["h"] or "", r["prediction"]) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("block", [1, 3, 256])
def test_equals_the_other_routes(spark, block):
    model = _network()
    df, x = _rows(spark)
    got = _values(score_relational(df, model.to_frame(spark), block=block))
    native = _values(score(df, model))
    assert [r[:2] for r in got] == [r[:2] for r in native]
    for a, b in zip(got, native, strict=True):
        assert (a[2] is None) == (b[2] is None)
        if a[2] is not None:
            assert np.allclose(a[2], b[2], atol=1e-12) and np.allclose(a[2], model.forward(x[a[0]][None])[0], atol=1e-12)


def test_normaliser_and_mixed_activations(spark):
    model = Model.build("m", [(np.arange(12.0).reshape(4, 3) / 8, [0.5, -1.0, 0.0, 0.25], ["relu", "tanh", "sigmoid", "linear"]), ([[1.0, -1.0, 2.0, 0.5]], [0.125], "linear")])
    model = model.with_normaliser(Normaliser("minmax", np.array([1.0, 2.0, 3.0]), np.array([0.5, 0.0, 2.0]), -1.0))
    df = spark.createDataFrame([(i, [i / 4, i / 2, -float(i)], "") for i in range(20)], "id BIGINT, features ARRAY<DOUBLE>, h STRING")
    got, native = _values(score_relational(df, model.to_frame(spark), block=2)), _values(score(df, model))
    assert np.allclose([r[2] for r in got], [r[2] for r in native], atol=1e-12)


def test_scalar_ragged_and_empty(spark):
    table = demo_scalar_model().to_frame(spark)
    df = spark.createDataFrame([(1, 53.12), (2, None), (3, float("nan"))], "id BIGINT, features DOUBLE")
    got = dict(score_relational(df, table).select("id", "prediction").collect())
    assert got[2] is None and got[3] is None and got[1] == score(df, demo_scalar_model()).where("id = 1").first()["prediction"]
    assert score_relational(df.limit(0), table).collect() == []
    ragged = spark.createDataFrame([(1, [1.0])], "id BIGINT, features ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="width"):
        score_relational(ragged, demo_class_model().to_frame(spark)).collect()


def test_no_broadcast_of_weights_and_no_single_partition(spark):
    df, _ = _rows(spark)
    plan = score_relational(df, _network(widths=(7, 1), acts=("linear",)).to_frame(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    product = text[text.index("SortMergeJoin"):]
    assert "at#" in product and "BroadcastExchange" not in product and "SinglePartition" not in text


def test_a_network_over_the_limit_scores(spark, tmp_path, monkeypatch):
    """2.1 million weights against a limit of one million: refused by the loader, scored from its table."""
    units, inputs = 700, 3000
    weight = F.transform(F.sequence(F.lit(0), F.lit(inputs - 1)), lambda i: ((F.col("id") * 7 + i * 3) % 11 - 5) / 8.0)
    first = spark.range(units).select(F.lit("big").alias("model_id"), F.lit(0).alias("layer"), F.col("id").cast("int").alias("unit"), weight.alias("weights"), F.lit(0.5).alias("bias"), F.lit("relu").alias("activation"))
    second = spark.createDataFrame([("big", 1, 0, [((u % 5) - 2) / 4 for u in range(units)], 0.25, "linear")], MODEL_SCHEMA)
    path = publish_model(first.union(second), str(tmp_path / "big"))
    with pytest.raises(ValueError, match="score_relational"):
        load_model(spark, path, max_weights=1_000_000)
    df = spark.createDataFrame([(k, [((i * k) % 13 - 6) / 4 for i in range(inputs)]) for k in range(4)], "id BIGINT, features ARRAY<DOUBLE>")
    got = dict(score_table(df, path, max_weights=1_000_000).select("id", "prediction").collect())
    w = ((np.arange(units)[:, None] * 7 + np.arange(inputs) * 3) % 11 - 5) / 8
    for k in range(4):
        h = np.maximum(w @ np.array([((i * k) % 13 - 6) / 4 for i in range(inputs)]) + 0.5, 0)
        assert got[k] == pytest.approx(h @ np.array([((u % 5) - 2) / 4 for u in range(units)]) + 0.25, abs=1e-9)
    small = score_table(spark.createDataFrame([(1, 2.0)], "id BIGINT, features DOUBLE"), demo_scalar_model().to_frame(spark))
    assert "SortMergeJoin" not in small._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("change, message", [
    ("layer = 5", "numbered"), ("unit = 9", "units are not"), ("weights = array(1d)", "inputs"), ("bias = double('nan')", "non-finite"),
    ("activation = 'swish'", "unknown"), ("activation = 'relu'", "mixes")])
def test_broken_tables_are_refused(spark, change, message):
    table = _network().to_frame(spark)
    name, value = change.split(" = ", 1)
    hit = F.expr("layer = 2 and unit = 1") if name != "layer" else F.expr("layer = 2")
    broken = table.withColumn(name, F.when(hit, F.expr(value)).otherwise(F.col(name)))
    df, _ = _rows(spark, 2)
    with pytest.raises(ValueError, match=message):
        score_relational(df, broken)
    with pytest.raises(ValueError, match="several"):
        score_relational(df, table.union(table.withColumn("model_id", F.lit("other"))))


def test_small_layers_deal_whole_rows_once(spark, monkeypatch):
    """However many small layers and blocks, rows are shuffled three times: dealt, and joined back."""
    acts = ("relu", "tanh", "linear", "sigmoid")
    model = _network(seed=4, widths=(7, 5, 6, 4, 1), acts=acts)
    df, x = _rows(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = score_relational(df, model.to_frame(spark), block=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning(__" in line for line in plan.splitlines()) == 2
        assert sum("Exchange hashpartitioning(salt" in line for line in plan.splitlines()) == 1 + len(acts)
        got = _values(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for (i, _, p), (_, _, q) in zip(got, _values(score(df, model)), strict=True):
        assert (p is None) == (q is None) and (p is None or np.allclose([p, p], [q, model.forward(x[i][None])[0][0]], atol=1e-12))


def test_small_layers_have_the_sums_of_blocks(spark, monkeypatch):
    from veloscore.operators import relational

    model = _network(seed=5, widths=(9, 4, 3, 5, 2), acts=("tanh", "relu", "sigmoid", "linear"))
    df, _ = _rows(spark, width=9)
    got = {}
    for tile, chained in ((relational.TILE, 8), (relational.TILE, 1), (13, 8), (0, 8)):
        monkeypatch.setattr(relational, "TILE", tile)
        monkeypatch.setattr(relational, "CHAINED", chained)
        got[tile, chained] = _values(score_relational(df, model.to_frame(spark), block=2))
    assert all(v == got[0, 8] for v in got.values())
