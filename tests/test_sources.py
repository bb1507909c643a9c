import pytest
from pyspark.sql import functions as F

from support import SF_MID
from veloscore.sources.series import read_series, series_from_table, write_series_csv
from veloscore.session import scratch_path


def test_reads_reference_format(spark, write_text):
    p = write_text("s.csv", "1594606095,108\n1594606155,104\n1594606215,102\n")
    df = read_series(spark, p)
    assert df.dtypes == [("unix_time", "bigint"), ("value", "double")]
    assert [tuple(r) for r in df.orderBy("unix_time").collect()] == [
        (1594606095, 108.0), (1594606155, 104.0), (1594606215, 102.0)]


def test_blank_line_is_skipped(spark, write_text):
    p = write_text("b.csv", "1,5\n\n2,6\n")
    assert read_series(spark, p).count() == 2


def test_empty_cell_is_null_not_error(spark, write_text):
    p = write_text("e.csv", "1,\n")
    assert [tuple(r) for r in read_series(spark, p).collect()] == [(1, None)]


def test_bad_cell_failfast_fails_on_read_of_value(spark, write_text):
    p = write_text("bad.csv", "1,x\n2,3\n")
    with pytest.raises(Exception):
        read_series(spark, p).select("value").collect()


def test_bad_cell_permissive_keeps_raw_line(spark, write_text):
    p = write_text("bad.csv", "1,x\n2,3\n")
    df = read_series(spark, p, mode="PERMISSIVE", corrupt_column="_corrupt")
    rows = {r["unix_time"]: (r["value"], r["_corrupt"]) for r in df.collect()}
    assert rows == {1: (None, "1,x"), 2: (3.0, None)}


def test_short_and_long_rows_go_to_corrupt_column(spark, write_text):
    p = write_text("sl.csv", "1\n1,2,3\n4,5\n")
    df = read_series(spark, p, mode="PERMISSIVE", corrupt_column="_corrupt")
    bad = sorted(r["_corrupt"] for r in df.collect() if r["_corrupt"] is not None)
    assert bad == ["1", "1,2,3"]


def test_short_row_fails_under_failfast(spark, write_text):
    p = write_text("s.csv", "1\n2,3\n")
    with pytest.raises(Exception):
        read_series(spark, p).collect()


def test_parquet_series(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "unix_time BIGINT, value DOUBLE")
    df.write.parquet(str(tmp_path / "p"))
    assert read_series(spark, str(tmp_path / "p"), fmt="parquet").collect()[0] == (1, 2.0)


def test_epoch_seconds_is_zone_independent(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12, 0, 0, 500000),),
                                (dt.datetime(1969, 12, 31, 23, 59, 59, 500000),),
                                (dt.datetime(1970, 1, 1),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = [r[0] for r in series_from_table(df.withColumn("value", F.lit(1.0))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [1719835200, -1, 0]


def test_csv_roundtrip_of_events_is_exact(spark):
    ev = series_from_table(spark.read.parquet(f"{SF_MID}/events.parquet"))
    path = write_series_csv(ev, scratch_path(spark, "t-series"))
    back = read_series(spark, path)
    assert back.exceptAll(ev).count() == 0 and ev.exceptAll(back).count() == 0


def test_scratch_path_lives_under_checkpoint_dir(spark):
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root.rstrip("/"))


def test_check_series_catches_what_count_hides(spark, write_text):
    from veloscore.sources.series import check_series
    p = write_text("bad.csv", "1,x\n2,3\n3,4\n")
    df = read_series(spark, p)
    assert df.count() == 3  # count() parses nothing, so FAILFAST does not fire
    with pytest.raises(Exception):
        check_series(df)
    good = write_text("good.csv", "1,2\n2,\n")
    assert check_series(read_series(spark, good)) == {"rows": 2, "unix_time": 2, "value": 1}


def test_dropmalformed_and_several_paths(spark, write_text):
    a = write_text("a.csv", "1,2\n2,x\n")
    b = write_text("b.csv", "3,4\n")
    df = read_series(spark, [a, b], mode="DROPMALFORMED")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2.0), (3, 4.0)]


@pytest.mark.parametrize("skip", [0, 1, 3])
def test_skip_lines_of_every_file(spark, tmp_path, skip):
    """Several files, several splits each, of different lengths; one shorter than what is skipped."""
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for k, n in enumerate((0, 2, 400, 3000)):
        lines = [f"{k * 10_000 + i},{i}.5" for i in range(n)]
        (folder / f"part-{k}.csv").write_text("\n".join([*lines, ""]))
        want += [(k * 10_000 + i, i + 0.5) for i in range(skip, n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1024)
    try:
        got = read_series(spark, str(folder), skip=skip)
        assert got.rdd.getNumPartitions() > 10
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_skip_reaches_into_a_second_split(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("".join(f"# a comment line that is long enough to fill a split {i}\n" for i in range(50)) + "1,2\n3,4\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        assert sorted(map(tuple, read_series(spark, str(p), skip=50).collect())) == [(1, 2.0), (3, 4.0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_skip_keeps_the_parse_modes(spark, write_text):
    p = write_text("m.csv", "name,unit\n\n1,5\n2,x\n\n3,\n")
    for mode, want in (("PERMISSIVE", [(1, 5.0), (2, None), (3, None)]), ("DROPMALFORMED", [(1, 5.0), (3, None)])):
        assert sorted(map(tuple, read_series(spark, p, skip=2, mode=mode).collect())) == want
    kept = read_series(spark, p, skip=2, mode="PERMISSIVE", corrupt_column="bad").orderBy("unix_time").collect()
    assert [r["bad"] for r in kept] == [None, "2,x", None]
    with pytest.raises(Exception):
        read_series(spark, p, skip=2).collect()
    with pytest.raises(ValueError):
        read_series(spark, p, skip=-1)
    with pytest.raises(ValueError):
        read_series(spark, p, skip=1, header=True)
