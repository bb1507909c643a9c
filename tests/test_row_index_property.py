"""Property: the distributed row index equals a brute-force single-window row_number on small
random inputs with NULLs, NaNs and many exact copies (ties are exact copies, so the multiset of
(key, row_no) is fully determined)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from veloscore.operators.indexing import row_index

keys = st.tuples(st.one_of(st.none(), st.integers(-3, 3)),
                 st.one_of(st.none(), st.sampled_from([float("nan"), -0.5, 0.0, 2.25])))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(keys, min_size=0, max_size=120), per_bucket=st.integers(1, 40))
def test_row_index_equals_brute_force(spark, rows, per_bucket):
    df = spark.createDataFrame(rows, "k BIGINT, x DOUBLE").repartition(3)
    got = sorted(repr(tuple(r)) for r in row_index(df, ["k", "x"], rows_per_bucket=per_bucket)
                 .select("k", "x", "row_no").collect())
    w = Window.orderBy(F.col("k").asc_nulls_first(), F.col("x").asc_nulls_first())
    exp = sorted(repr(tuple(r)) for r in df.select("k", "x", F.row_number().over(w)).collect())
    assert got == exp
