from pyspark.sql import functions as F

from veloscore.plans.jobs import score_and_report
from veloscore.session import scratch_path
from veloscore.sources.model_table import demo_scalar_model
from veloscore.sources.series import read_series
from veloscore.streaming import run_available, score_stream


def _files(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for k in range(3):
        (d / f"part{k}.csv").write_text("".join(f"{1594606095 + 60 * (10 * k + i)},{90 + i + k}\n"
                                                for i in range(10)))
    return str(d)


def test_stream_report_equals_batch_report(spark, tmp_path):
    src = _files(tmp_path)
    out, ckpt = scratch_path(spark, "t-stream-out"), scratch_path(spark, "t-stream-ckpt")
    q = run_available(score_stream(spark, src, demo_scalar_model(), max_files_per_trigger=1),
                      out, ckpt)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    got = spark.read.parquet(out)
    exp = score_and_report(read_series(spark, src), demo_scalar_model(), by_time=True).drop("row_no")
    assert got.count() == 30
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_restart_scores_only_new_files(spark, tmp_path):
    src = _files(tmp_path)
    out, ckpt = scratch_path(spark, "t-stream-out"), scratch_path(spark, "t-stream-ckpt")
    run_available(score_stream(spark, src, demo_scalar_model(), route="udf"), out, ckpt)
    (tmp_path / "in" / "part9.csv").write_text("1594700000,100\n")
    run_available(score_stream(spark, src, demo_scalar_model(), route="udf"), out, ckpt)
    got = spark.read.parquet(out)
    assert got.count() == 31 and got.where(F.col("unix_time") == 1594700000).count() == 1
