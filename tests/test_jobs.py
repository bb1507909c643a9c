import numpy as np
import pytest
from pyspark.sql import functions as F

from support import SF_SMALL
from veloscore.operators.scoring import score_batched
from veloscore.plans.jobs import score_and_count, score_and_report, scored, timed_run, timed_runs
from veloscore.plans.sinks import scored_count, show_lines, write_predictions
from veloscore.session import scratch_path
from veloscore.sources.model_table import demo_scalar_model
from veloscore.sources.series import read_series, series_from_table


def _series(spark):
    return series_from_table(spark.read.parquet(f"{SF_SMALL}/events.parquet"))


def test_report_schema_and_line_format(spark, write_text):
    p = write_text("s.csv", "1594606155,104\n1594606095,108\n")
    rep = score_and_report(read_series(spark, p), demo_scalar_model())
    assert rep.columns == ["row_no", "unix_time", "key", "predicted", "actual", "line"]
    rows = rep.orderBy("row_no").collect()
    assert [r["unix_time"] for r in rows] == [1594606095, 1594606155]
    assert rows[0]["line"] == f"Row:1 ==> Predicted:{rows[0]['predicted']} - Actual:108"
    tr = score_and_report(read_series(spark, p), demo_scalar_model(), by_time=True)
    assert tr.orderBy("row_no").first()["line"].startswith("Unix-time:1594606095 ==> Predicted:")


def test_report_prints_null_for_missing_value(spark, write_text):
    p = write_text("n.csv", "1,\n2,3\n")
    rows = score_and_report(read_series(spark, p), demo_scalar_model()).orderBy("row_no").collect()
    assert rows[0]["line"] == "Row:1 ==> Predicted:null - Actual:null"


def test_routes_give_the_same_report(spark):
    a = score_and_report(_series(spark), demo_scalar_model(), route="native")
    b = score_and_report(_series(spark), demo_scalar_model(), route="udf", batch_size=7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_report_plan_has_no_single_partition(spark):
    ev = series_from_table(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    rep = score_and_report(ev, demo_scalar_model())
    plan = rep._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_count_scores_every_row(spark):
    c = score_and_count(_series(spark), demo_scalar_model()).first()
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert c["records"] == n and c["scored"] == n and c["prediction_sum"] > 0


def test_timed_run_evaluates_the_predictor(spark):
    acc = spark.sparkContext.accumulator(0)

    def make_predict_fn():
        def predict(x):
            acc.add(len(x))
            return np.zeros(len(x))
        return predict
    s = scored(_series(spark), demo_scalar_model(), route="native")
    df = score_batched(s.drop("prediction"), demo_scalar_model(), make_predict_fn=make_predict_fn)
    df.count()
    assert acc.value == 0  # count() prunes the prediction away: nothing is scored
    r = timed_run(df)
    assert acc.value == r["rows"] > 0


def test_timed_runs_table(spark):
    t = timed_runs(scored(_series(spark), demo_scalar_model()), 2)
    rows = t.orderBy("iteration").collect()
    assert t.columns == ["iteration", "rows", "elapsed_ms", "cumulative_ms", "mean_ms"]
    assert [r["iteration"] for r in rows] == [1, 2]
    assert rows[1]["cumulative_ms"] == rows[0]["elapsed_ms"] + rows[1]["elapsed_ms"]
    assert rows[1]["mean_ms"] == pytest.approx(rows[1]["cumulative_ms"] / 2)
    with pytest.raises(ValueError):
        timed_runs(scored(_series(spark), demo_scalar_model()), 0)


def test_sinks_write_and_show(spark, capsys):
    rep = score_and_report(_series(spark), demo_scalar_model())
    for fmt in ("text", "csv", "parquet"):
        path = write_predictions(rep, scratch_path(spark, f"t-{fmt}"), fmt=fmt)
        reader = getattr(spark.read.option("header", True), fmt)
        assert reader(path).count() == rep.count()
    lines = show_lines(rep, 3)
    assert len(lines) == 3 and lines[0].startswith("Row:1 ==>")
    assert "Row:1 ==>" in capsys.readouterr().out


def test_vector_report_and_count(spark):
    from veloscore.operators.features import split_features
    from veloscore.operators.indexing import row_index
    from veloscore.operators.reporting import report
    from veloscore.operators.scoring import score
    from veloscore.sources.model_table import Model
    m = Model.build("v2x2", [([[1.0, 0.0], [0.0, -2.0]], [0.5, 0.0], "linear")])
    df = spark.createDataFrame([(1, 3.7, 2.0), (2, -1.2, 1.0)], "unix_time BIGINT, a DOUBLE, b DOUBLE")
    s = score(split_features(row_index(df, ["unix_time"]), 0, 0, keep=("row_no",)).withColumn("key", F.lit("Predicted")), m)
    rows = report(s).orderBy("row_no").collect()
    assert [(r["predicted"], r["actual"]) for r in rows] == [(4, 3), (0, -1)]
    c = scored_count(s).first()
    assert (c["records"], c["scored"]) == (2, 2) and c["prediction_sum"] == pytest.approx(4.2 - 0.7)


def test_count_sum_survives_huge_predictions(spark):
    df = spark.createDataFrame([(1e12,), (2.5,), (None,)], "prediction DOUBLE")
    c = scored_count(df).first()
    assert (c["records"], c["scored"], c["prediction_sum"]) == (3, 2, 1e12 + 2.5)
