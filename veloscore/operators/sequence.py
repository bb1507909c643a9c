"""M1, recurrent layer: a gated cell folded over ordered sequences, one prediction a row.

A sequence is the rows of one key in the order of other columns; sequences are independent, so the
work is partitioned by key and no plan has a single partition. One sequence's steps depend on each
other: a state passes from row to row, and between chunks of rows.

* ``native``: rows of one key and time chunk are one sorted array, folded by ``aggregate`` with a
  struct of the state and what it has put out. Chunks are taken in the order of time, one job each for all
  keys together, and the state that a key leaves a chunk with is a row of a table for the next, written
  to the shared scratch folder. A chunk's length bounds the arrays.
* ``udf``: rows are partitioned by key and sorted within; Arrow batches are the chunks, and the state
  of a key that goes on is carried to the next batch. All keys of a batch take a step together.

Both give the same. A row whose features are NULL, or hold a NULL or NaN, has a NULL prediction and
leaves the state as it is. Rows with one key that tie on all order columns have no order: add an id.
NULL is a key like any other. A key with a third of all rows is one long sequence, whose steps no
engine can take at once; ``native`` holds one chunk of it at a time, ``udf`` one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloscore.functions.columns import any_missing
from veloscore.operators.scoring import score_native
from veloscore.session import scratch_path
from veloscore.sources.sequence_model import Cell, SequenceModel

#: Jobs that one native run may take.
MAX_CHUNKS = 4096

_KEY, _CHUNK, _H, _X = "__seq_key", "__seq_chunk", "__seq_h", "__seq_x"


def _num(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _weighted(x: str, weights: np.ndarray) -> list[str]:
    return [f"{x}[{i}] * {_num(v)}" for i, v in enumerate(weights)]


def _fold_sql(cell: Cell) -> str:
    """``aggregate`` over an array ``steps`` of (.., x) from a state ``h``: the last state, and the
    state after each step (NULL for one without features)."""
    n = cell.hidden

    def gate(g: int, u: int, state: str) -> str:
        k = g * n + u
        return "(" + " + ".join(_weighted("s.x", cell.inputs[k]) + [_num(cell.bias[k])] + _weighted(state, cell.state[k])) + ")"

    def sigmoid(z: str) -> str:
        return f"(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-{z})))"

    gates = ", ".join(f"array({', '.join(sigmoid(gate(g, u, 'a.h')) for u in range(n))}) AS {name}" for g, name in enumerate("zr"))
    passed = "array(" + ", ".join(f"g.r[{u}] * a.h[{u}]" for u in range(n)) + ")"
    candidate = "array(" + ", ".join(f"tanh({gate(2, u, 'p')})" for u in range(n)) + ")"
    after = "array(" + ", ".join(f"(CAST(1 AS DOUBLE) - g.z[{u}]) * a.h[{u}] + g.z[{u}] * c[{u}]" for u in range(n)) + ")"

    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    moved = let(f"struct({gates})", "g", let(let(passed, "p", candidate), "c", after))
    step = let(moved, "h", "named_struct('h', h, 'out', concat(a.out, array(h)))")
    kept = "named_struct('h', a.h, 'out', concat(a.out, array(CAST(NULL AS ARRAY<DOUBLE>))))"
    start = f"named_struct('h', {_H}, 'out', CAST(array() AS ARRAY<ARRAY<DOUBLE>>))"
    return f"aggregate(steps, {start}, (a, s) -> CASE WHEN s.x IS NULL THEN {kept} ELSE {step} END)"


def _prepared(df: DataFrame, model: SequenceModel, features_col: str, keys: list[str]) -> DataFrame:
    vector = isinstance(df.schema[features_col].dataType, T.ArrayType)
    x = F.col(features_col).cast("array<double>") if vector else F.array(F.col(features_col).cast("double"))
    width = model.cell.width
    wrong = F.raise_error(F.concat(F.lit(f"feature vector width differs from the cell's {width} inputs: got "), F.size(x).cast("string")))
    x = F.when(any_missing(x), F.lit(None)).when(F.size(x) != width, wrong).otherwise(x)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    return df.select("*", key.alias(_KEY), x.alias(_X))


def _native(rows: DataFrame, model: SequenceModel, order: list[str], columns: list[str], chunk: Column) -> DataFrame:
    """rows with the state after each: one round a chunk of time."""
    spark = rows.sparkSession
    zero = F.array(*[F.lit(0.0)] * model.cell.hidden)
    # one array a key and chunk, in files: each round reads the chunk that it is at
    packed = rows.withColumn(_CHUNK, chunk).groupBy(_CHUNK, _KEY).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row"), F.col(_X).alias("x")))).alias("steps"))
    folder = scratch_path(spark, "sequence")
    packed.write.partitionBy(_CHUNK).parquet(f"{folder}/chunks")
    packed = spark.read.schema(packed.schema).parquet(f"{folder}/chunks")
    numbers = [r[0] for r in packed.select(_CHUNK).distinct().orderBy(_CHUNK).limit(MAX_CHUNKS + 1).collect()]
    if len(numbers) > MAX_CHUNKS:
        raise ValueError(f"more than {MAX_CHUNKS} chunks; make them longer")
    state = None
    for k, number in enumerate(numbers):
        own = packed.where(F.col(_CHUNK) == number).select(_KEY, "steps")
        if state is None:
            begun = own.withColumn(_H, zero)
        else:
            begun = own.join(state, _KEY, "full").withColumn(_H, F.coalesce(_H, zero))
        folded = begun.select(_KEY, _H, "steps", F.when(F.col("steps").isNotNull(), F.expr(_fold_sql(model.cell))).alias("done"))
        folded = folded.select(_KEY, "steps", F.coalesce("done.h", _H).alias(_H), F.col("done.out").alias("out"))
        folded.write.parquet(f"{folder}/done/{_CHUNK}={k}")
        state = spark.read.parquet(f"{folder}/done/{_CHUNK}={k}").select(_KEY, _H)
    if state is None:
        return rows.select(*columns, F.lit(None).cast("array<double>").alias(_H))
    done = spark.read.parquet(f"{folder}/done").where("steps is not null")
    each = done.select(F.inline(F.arrays_zip(F.transform("steps", lambda s: s["row"]).alias("row"), F.col("out").alias("h"))))
    return each.select("row.*", F.col("h").alias(_H))


def _batches(cell: Cell, fields: list[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(cell.hidden)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(_KEY)).to_numpy(zero_copy_only=False)
            x = batch.column(batch.schema.get_field_index(_X))
            known = np.asarray(x.is_valid())
            values = np.zeros((len(keys), cell.width))
            values[known] = np.asarray(x.flatten()).reshape(-1, cell.width)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            length = np.diff(np.append(first, len(keys)))
            h = np.zeros((len(first), cell.hidden))
            if keys[0] == last:
                h[0] = carried
            out = np.empty((len(keys), cell.hidden))
            # the longest sequences first, so that those still going are a prefix
            order = np.argsort(-length, kind="stable")
            going = np.searchsorted(-length[order], -np.arange(length.max()), "left")
            for step in range(int(length.max())):
                who = order[:going[step]]
                at = first[who] + step
                ok = known[at]
                h[who[ok]] = cell.step(h[who[ok]], values[at[ok]])
                out[at] = h[who]
            last, carried = keys[-1], h[-1].copy()
            states = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * cell.hidden, pa.int32()), pa.array(out.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in fields), states], names=[*fields, _H])

    return fold


def score_sequence(df: DataFrame, model: SequenceModel, key_cols: list[str], order_cols: list[str], *, features_col: str = "value",
                   out_col: str = "prediction", route: str = "native", chunk: Column | None = None) -> DataFrame:
    """``df`` with the recurrent network's prediction at each row.

    ``chunk`` (native route) is an integer column that never falls along ``order_cols``, such as whole
    days; None takes each sequence as one chunk, for short ones.
    """
    keys, order = list(key_cols), list(order_cols)
    columns = df.columns
    rows = _prepared(df, model, features_col, keys)
    if route == "native":
        states = _native(rows, model, order, columns, F.lit(0) if chunk is None else chunk.cast("bigint"))
    elif route == "udf":
        own = [f for f in rows.schema.fields if f.name in columns]
        schema = T.StructType([*own, T.StructField(_H, T.ArrayType(T.DoubleType()))])
        sorted_rows = rows.repartition(_KEY).sortWithinPartitions(_KEY, *order)
        states = sorted_rows.mapInArrow(_batches(model.cell, columns), schema)
    else:
        raise ValueError(f"unknown route {route!r}")
    scored = score_native(states, model.head, _H, out_col)
    return scored.select(*[F.col(f"`{c}`") for c in columns], F.col(out_col))
