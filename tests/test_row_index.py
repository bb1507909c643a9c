import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from support import SF_MID
from veloscore.operators.indexing import row_index
from veloscore.sources.series import read_series


def _check_gap_free(df, n):
    r = df.agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no"), F.count("*")).first()
    assert tuple(r) == (1, n, n, n)


def test_matches_duckdb_with_extra_columns(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet")
    got = dict(row_index(ev, ["ts", "event_id"]).select("event_id", "row_no").collect())
    exp = dict(duckdb.sql(f"select event_id, row_number() over (order by ts, event_id) "
                          f"from '{SF_MID}/events.parquet'").fetchall())
    assert got == exp


def test_duplicate_times_are_distinct_and_gap_free(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 4.0), (0, 9.0), (2, 1.0)],
                               "unix_time BIGINT, value DOUBLE")
    out = row_index(df, ["unix_time", "value"])
    _check_gap_free(out, 5)
    assert sorted((r[0], r[1], r[2]) for r in out.collect()) == [
        (0, 9.0, 1), (1, 4.0, 2), (1, 5.0, 3), (1, 5.0, 4), (2, 1.0, 5)]


def test_nulls_first_nan_last(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (1, 2.0)], "unix_time BIGINT, value DOUBLE")
    out = {r["row_no"]: r["value"] for r in row_index(df, ["unix_time", "value"]).collect()}
    assert out[1] is None and out[2] == 2.0 and out[3] != out[3]


def test_two_files_follow_key_not_file(spark, tmp_path):
    d = tmp_path / "two"
    d.mkdir()
    (d / "a.csv").write_text("30,1\n10,2\n")
    (d / "b.csv").write_text("".join(f"{t},{t % 7}\n" for t in range(100, 0, -3)))
    df = read_series(spark, str(d))
    out = sorted((r["row_no"], r["unix_time"], r["value"]) for r in row_index(df, ["unix_time", "value"]).collect())
    keys = [(t, v) for _, t, v in out]
    assert keys == sorted(keys) and [n for n, _, _ in out] == list(range(1, len(out) + 1))


def test_hot_group_of_copies_is_split_across_buckets(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet").select("ts", "value")
    hot = spark.range(5000).select(F.lit(ev.first()["ts"]).alias("ts"), F.lit(1.5).alias("value"))
    df = ev.unionByName(hot).repartition(4)
    out = row_index(df, ["ts", "value"], rows_per_bucket=500)
    _check_gap_free(out, 15000)
    # No task of the numbering stage holds the whole hot group.
    per_task = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 5000


def test_plan_has_no_single_partition_exchange(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet")
    plan = row_index(ev, ["ts", "event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(__ri_bucket" in plan


def test_empty_input(spark):
    df = spark.createDataFrame([], "unix_time BIGINT, value DOUBLE")
    assert row_index(df, ["unix_time"]).collect() == []


def test_unique_key_mode_matches_and_reads_keys_only(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet")
    a = row_index(ev, ["ts", "event_id"], unique=True).select("event_id", "row_no")
    b = row_index(ev, ["ts", "event_id"]).select("event_id", "row_no")
    assert a.exceptAll(b).count() == 0
    # Tie-breakers hash only the non-key columns; a key-only frame needs no hash at all.
    plan = row_index(ev.select("ts", "event_id"), ["ts", "event_id"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "xxhash64" not in plan


def test_many_buckets_and_key_types_match_brute_force(spark):
    """> 63 bounds uses the array search; every literal type must round-trip exactly."""
    import datetime as dt
    from decimal import Decimal
    from pyspark.sql import Window
    rows = []
    for i in range(3000):
        rows.append((f"k{i % 17}'\\\\x\n" if i % 5 else None,
                     dt.date(2020, 1, 1) + dt.timedelta(days=i % 11),
                     dt.datetime(2024, 3, 10, 1, 30) + dt.timedelta(minutes=i % 97),
                     Decimal(i % 23) / Decimal(7) if i % 9 else None,
                     float(i % 13) if i % 4 else float("nan"), i))
    df = spark.createDataFrame(rows, "s STRING, d DATE, t TIMESTAMP, m DECIMAL(20,10), x DOUBLE, id INT")
    keys = ["s", "d", "t", "m", "x", "id"]
    got = dict(row_index(df, keys, rows_per_bucket=10).select("id", "row_no").collect())
    w = Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    exp = dict(df.select("id", F.row_number().over(w)).collect())
    assert got == exp


@pytest.mark.parametrize("n, buckets", [(60_000, 16), (300_000, 600)])
def test_bounds_come_from_a_sketch(spark, n, buckets):
    """Composite keys with ties: bounds ascend, and each bucket is off by the stated error at most."""
    from veloscore.operators import indexing as ix
    df = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("a"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("b"))
    types = {f.name: f.dataType for f in df.schema.fields}
    bounds = ix._sketched_bounds(df, ["a", "b"], types, n, buckets)
    assert len(bounds) == buckets - 1
    key = F.struct("a", "b")
    sizes = [r["count"] for r in df.groupBy(ix._bucket_expr(key, bounds).alias("x")).count().orderBy("x").collect()]
    assert len(sizes) == buckets and sum(sizes) == n
    off = np.abs(np.cumsum(sizes) / n - np.arange(1, buckets + 1) / buckets).max()
    assert off <= ix.rank_error(n, buckets) + 2 / n
    assert ix._levels(n, buckets)  # it did thin


def test_sketch_of_a_hot_key(spark):
    from veloscore.operators import indexing as ix
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") / 7).alias("a"))
    bounds = ix._sketched_bounds(df, ["a"], {"a": df.schema["a"].dataType}, 50_000, 30)
    assert 15 <= len(bounds) <= 29 and len(set(bounds)) == len(bounds)
