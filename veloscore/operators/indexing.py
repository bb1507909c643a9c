"""P5: a gap-free 1-based row number in key order, without a single-partition window.

``Window.orderBy`` with no partition moves every row into one task. Instead:

1. sketch the ordering key's quantiles as an aggregate that merges (below), take ``B - 1`` bounds;
2. give each row a bucket with a binary search over those literal bounds: an unrolled
   ``CASE WHEN key < bound ...`` tree (whole-stage codegen) for up to 64 buckets, else
   log2(B) steps of ``aggregate`` over a literal array; deterministic either way;
3. count rows per bucket (partial aggregation, B numbers reach the driver) and turn the counts
   into offsets, kept as a literal array;
4. ``row_number()`` over ``partitionBy(bucket).orderBy(key)`` plus the bucket's offset.

The key is the caller's columns followed by two tie-breakers: a hash of the other columns (if
there are any) and the id of the input split the row was read from. Rows tied on the caller's
key are interchangeable for the contract, and the tie-breakers make a hot key - even a third of
the table made of exact copies - spread over many buckets instead of landing in one task: the
sampled bounds fall inside the hot key, split by row hash and then by input split, so the
largest possible bucket is about one input split's worth of a single row value. With
``unique=True`` (the caller's key has no ties) the tie-breakers are left out; the bounds and
counts passes then read the key columns only.

The sketch is of composite keys of any type. A bounded sample of the keys is dealt into groups; each
group is thinned to every so-many-th key in Spark's own order, which then stands for those before it;
the thinned groups are dealt into fewer groups, until one holds all, and its ``B``-quantiles are the
bounds. Only those reach the driver. A thinning to m keys moves a rank by 1/m of the rows at most:
see :func:`rank_error`.

Bounds, counts and the final numbering all see the same deterministic bucket expression, so the
offsets always match the rows (unlike a bucket read from ``spark_partition_id`` after a range
shuffle, which is only valid while both branches share one exchange). Index before scoring:
the input is read three times (sample, counts, rows), so it must be cheap and deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_H = "__ri_hash"
_P = "__ri_split"
_B = "__ri_bucket"


def _hashable(field: T.StructField) -> bool:
    def ok(dt: T.DataType) -> bool:
        if isinstance(dt, T.MapType):
            return False
        if isinstance(dt, T.ArrayType):
            return ok(dt.elementType)
        if isinstance(dt, T.StructType):
            return all(ok(f.dataType) for f in dt.fields)
        return True
    return ok(field.dataType)


def _to_driver(name: str, dt: T.DataType) -> Column:
    """Sample column in a form whose Python value turns back into the exact same literal."""
    c = F.col(name)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).alias(name)
    if isinstance(dt, T.TimestampNTZType):
        return c.cast("string").alias(name)
    return c


def _sql_literal(value, dt: T.DataType) -> str:
    """Exact SQL text for one sampled key value (see ``_to_driver`` for timestamps)."""
    type_sql = dt.simpleString()
    if value is None:
        return f"CAST(NULL AS {type_sql})"
    if isinstance(dt, T.BooleanType):
        return "TRUE" if value else "FALSE"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({int(value)} AS {type_sql})"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return f"CAST('{float(value)!r}' AS {type_sql})"
    if isinstance(dt, T.DecimalType):
        return f"CAST('{value}' AS {type_sql})"
    if isinstance(dt, T.StringType):
        return f"CAST(X'{value.encode('utf-8').hex()}' AS STRING)"
    if isinstance(dt, T.BinaryType):
        return f"X'{bytes(value).hex()}'"
    if isinstance(dt, T.DateType):
        return f"DATE'{value.isoformat()}'"
    if isinstance(dt, T.TimestampType):
        return f"TIMESTAMP_MICROS({int(value)})"
    if isinstance(dt, T.TimestampNTZType):
        return f"CAST('{value}' AS TIMESTAMP_NTZ)"
    raise TypeError(f"row_index cannot order by a column of type {type_sql}")


def _bound_sql(row, names: list[str], types: dict[str, T.DataType]) -> str:
    fields = ", ".join(f"'{n}', {_sql_literal(row[n], types[n])}" for n in names)
    return f"named_struct({fields})"


#: Up to this many bounds the search is an unrolled CASE tree (whole-stage codegen); beyond it
#: the tree's generated code grows too large to compile, so a loop over a literal array is used.
TREE_BOUNDS = 63

#: Small inputs are not cut into buckets smaller than this (a bucket is one window group).
MIN_BUCKET_ROWS = 5_000


def _bucket_tree(key: Column, bounds: list[Column], lo: int, hi: int) -> Column:
    """Bounds are SQL texts; one ``F.expr`` per bound."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(key < F.expr(bounds[mid - 1]), _bucket_tree(key, bounds, lo, mid - 1)) \
            .otherwise(_bucket_tree(key, bounds, mid, hi))


def _bucket_search(key: Column, bounds: list[str]) -> Column:
    """Binary search in a sorted literal array: ceil(log2(k + 1)) steps of ``aggregate``. The
    array is one SQL literal, parsed once."""
    k = len(bounds)
    arr = F.expr("array(" + ", ".join(bounds) + ")")
    steps = max(1, math.ceil(math.log2(k + 1)))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.shiftright(lo + hi, 1)
        le = F.try_element_at(arr, mid + 1) <= key
        moved = F.when(le, F.struct((mid + 1).alias("lo"), hi.alias("hi"))) \
                 .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo < hi, moved).otherwise(acc)

    init = F.struct(F.lit(0).alias("lo"), F.lit(k).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def _bucket_expr(key: Column, bounds: list[str]) -> Column:
    """Bucket j holds keys with bounds[j-1] <= key < bounds[j] (the number of bounds <= key)."""
    if len(bounds) <= TREE_BOUNDS:
        return _bucket_tree(key, bounds, 0, len(bounds))
    return _bucket_search(key, bounds)


#: Keys that one group of the sketch holds, at least; a thinned group keeps a quarter.
SKETCH_GROUP = 4_096


def _group_size(n_buckets: int) -> int:
    return max(SKETCH_GROUP, 8 * n_buckets)


def _levels(size: int, n_buckets: int) -> list[int]:
    """The number of groups in each thinning before the last."""
    full, out = _group_size(n_buckets), []
    while size > full:
        out.append(math.ceil(size / full))
        size = out[-1] * (full // 4)
    return out


def rank_error(sampled: int, n_buckets: int) -> float:
    """The largest share of the sampled keys by which a bound's rank can be off: a share of one
    thinned key for each thinning. (Sampling adds its own, about 1 / sqrt(sampled).)"""
    return len(_levels(sampled, n_buckets)) * 4 / _group_size(n_buckets)


def _thinned(keys: DataFrame, groups: int, keep: int, salt: int) -> DataFrame:
    """keys(k, w): of each group those at which the weight passes another ``keep``-th of its total, with
    the weight passed, and ``cum``, the weight up to there."""
    group = F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(groups))
    w = Window.partitionBy("g")
    upto = w.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = keys.withColumn("g", group).select("k", "w", F.sum("w").over(upto).alias("cum"), F.sum("w").over(w).alias("total"))
    step = lambda c: F.floor(c * keep / F.col("total") + 1e-9)
    passed = step(F.col("cum")) - step(F.col("cum") - F.col("w"))
    return cum.select("k", (passed * F.col("total") / keep).alias("w"), "cum").where(F.col("w") > 0)


def _sketched_bounds(sample: DataFrame, names: list[str], types: dict[str, T.DataType], size: int, n_buckets: int) -> list[str]:
    """SQL texts of up to ``n_buckets - 1`` bounds, ascending."""
    keys = sample.select(F.struct(*names).alias("k"), F.lit(1.0).alias("w"))
    for salt, groups in enumerate(_levels(size, n_buckets)):
        keys = _thinned(keys, groups, _group_size(n_buckets) // 4, salt).select("k", "w")
    last = _thinned(keys, 1, n_buckets, 0).select("k.*", "cum").select(*[_to_driver(c, types[c]) for c in names], "cum")
    rows = sorted(last.collect(), key=lambda r: r["cum"])  # n_buckets rows at most
    return list(dict.fromkeys(_bound_sql(row, names, types) for row in rows[:-1]))


def row_index(df: DataFrame, order_by: list[str] | tuple[str, ...], col: str = "row_no", *,
              unique: bool = False, rows_per_bucket: int = 2_000_000, max_buckets: int = 16384,
              sample_per_bucket: int = 40, max_sample: int = 300_000, seed: int = 7) -> DataFrame:
    """Add ``col`` (BIGINT, 1..n) numbering the rows in ascending ``order_by`` order
    (NULLs first, NaN last, as Spark sorts).

    The number of buckets grows with the row count (``rows_per_bucket``) up to ``max_buckets``
    and is at least four per shuffle partition (unless that makes buckets smaller than
    ``MIN_BUCKET_ROWS``), so buckets spread evenly over tasks. About ``max_sample`` sampled keys
    at most (``sample_per_bucket`` per bucket below that) are sketched on the executors; the driver
    gets the bounds. Three small jobs run when this is called: a row count (metadata only for
    Parquet), the sketch, and the per-bucket counts.
    """
    order_by = list(order_by)
    missing = [c for c in order_by if c not in df.columns]
    if missing:
        raise ValueError(f"order columns {missing} not in {df.columns}")
    spark = df.sparkSession
    tie: list[Column] = []
    if not unique:
        others = [F.col(f"`{f.name}`") for f in df.schema.fields
                  if f.name not in order_by and _hashable(f)]
        if others:
            tie.append(F.xxhash64(*others).alias(_H))
        tie.append(F.spark_partition_id().alias(_P))
    keyed = df.select("*", *tie)
    key_names = order_by + [c for c in (_H, _P) if c in keyed.columns]
    key_types = {f.name: f.dataType for f in keyed.schema.fields}

    n = df.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Enough buckets for the data (rows_per_bucket), at least four per shuffle partition for
    # balance - but never buckets of fewer than MIN_BUCKET_ROWS rows - and at most max_buckets.
    n_buckets = max(math.ceil(n / rows_per_bucket), min(4 * parts, math.ceil(n / MIN_BUCKET_ROWS)))
    n_buckets = max(1, min(max_buckets, n_buckets))

    bounds: list[str] = []
    if n_buckets > 1:
        target = min(max_sample, sample_per_bucket * n_buckets)
        fraction = min(1.0, target / n)
        sample = keyed.select(*key_names).sample(False, fraction, seed)
        bounds = _sketched_bounds(sample, key_names, key_types, target, n_buckets)
    key = F.struct(*[F.col(c) for c in key_names])
    keyed = keyed.withColumn(_B, _bucket_expr(key, bounds))

    counts = dict(keyed.groupBy(_B).count().collect())  # <= len(bounds) + 1 rows
    offsets, total = [], 0
    for b in range(len(bounds) + 1):
        offsets.append(total)
        total += counts.get(b, 0)
    offset = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), F.col(_B) + 1)

    w = Window.partitionBy(_B).orderBy(*[F.col(c).asc_nulls_first() for c in key_names])
    return (keyed.withColumn(col, (F.row_number().over(w) + offset).cast("bigint"))
            .drop(*[c for c in (_H, _P) if c in keyed.columns], _B))
