"""M2: a network is built once by each Python worker, and jobs split by task."""

import os
from collections import Counter

import numpy as np
import pytest

from support import SF_SMALL
from veloscore.operators import attaching as at
from veloscore.operators.attaching import attach, held, score_attached
from veloscore.operators.normalise import fit_normaliser
from veloscore.operators.scoring import score
from veloscore.plans.jobs import scored, timed_partitions, timed_stage
from veloscore.sources.model_table import demo_class_model, demo_scalar_model, publish_model
from veloscore.sources.series import series_from_table


def _frame(spark, parts=24):
    return spark.createDataFrame([(i, float(i)) for i in range(480)], "id INT, features DOUBLE").repartition(parts)


def test_built_once_per_worker(spark, tmp_path):
    model = attach(spark, publish_model(demo_scalar_model(), str(tmp_path / "m"), spark), "demo-1-3-1")
    made, ran = str(tmp_path / "made"), str(tmp_path / "ran")

    def counting(attached):
        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")
        network = attached.read()

        def predict(x):
            with open(ran, "a") as f:
                f.write(f"{os.getpid()}\n")
            return network.forward(np.asarray(x).reshape(-1, 1))[:, 0]

        return predict

    for _ in range(2):  # two jobs of 24 tasks each
        out = dict(score_attached(_frame(spark), model, make_predictor=counting, batch_size=1000).select("id", "prediction").collect())
    expected = dict(score(_frame(spark), demo_scalar_model()).select("id", "prediction").collect())
    assert out == expected
    made, ran = (Counter(open(p).read().split()) for p in (made, ran))
    assert set(made.values()) == {1} and set(made) == set(ran)
    assert sum(ran.values()) >= 48 > len(made)


def test_a_new_table_is_another_network(spark, tmp_path):
    path = str(tmp_path / "m")
    a = attach(spark, publish_model(demo_class_model(), path, spark), "demo-64-4-3")
    changed = demo_class_model().with_normaliser(fit_normaliser(spark.createDataFrame([([float(i) for i in range(64)],), ([0.0] * 64,)], "features ARRAY<DOUBLE>")))
    changed.to_frame(spark).write.mode("overwrite").parquet(path)
    b = attach(spark, path, "demo-64-4-3")
    assert a.name != b.name and (b.n_inputs, b.n_outputs) == (64, 3)
    assert b.read().normaliser is not None
    with pytest.raises(ValueError, match="not found"):
        attach(spark, path, "other")
    with pytest.raises(ValueError, match="limit"):
        attach(spark, path, "demo-64-4-3", max_weights=10)


def test_held_predictors_are_bounded(monkeypatch):
    monkeypatch.setattr(at, "_HELD", type(at._HELD)())
    calls = []
    for name in [*range(at.MAX_HELD), 0, *range(at.MAX_HELD, at.MAX_HELD + 2), 0]:
        held(name, lambda name=name: calls.append(name) or name)
    assert len(at._HELD) == at.MAX_HELD and calls.count(0) == 1 and 1 not in at._HELD


def test_times_split_by_partition(spark):
    series = series_from_table(spark.read.parquet(f"{SF_SMALL}/events.parquet")).repartition(5)
    n = series.count()
    rows = timed_partitions(lambda: scored(series, demo_scalar_model())).orderBy("partition").collect()
    assert [r["partition"] for r in rows] == list(range(5)) and sum(r["rows"] for r in rows) == n == sum(r["scored"] for r in rows)
    assert all(0 <= r["wait_ms"] <= r["elapsed_ms"] for r in rows)
    m = timed_stage(scored(series, demo_scalar_model()))
    assert (m["rows"], m["scored"], m["partitions"]) == (n, n, 5)
    assert 0 <= m["least_ms"] <= m["mean_ms"] <= m["greatest_ms"] and m["elapsed_ms"] > 0
