"""M1, third form: the forward pass as a plan of joins and sums, for networks of any size.

The network stays a table. No weight passes the driver, a task's closure or a broadcast. Each layer
is a blocked matrix product:

* the layer's weight rows are cut into blocks of BLOCK inputs: (unit, input block, weights);
* the rows' values are cut the same way: (row, input block, values);
* the two are joined on the input block, one product gives a partial sum for (row, unit, block), and
  the partial sums are added in the order of the blocks, so results do not depend on the shuffle;
* bias and activation follow, layer-wide ones (softmax, normalise) from sums for each row, and the
  units are put together into blocks for the next layer.

The first layers need less if each has at most TILE weights and no layer-wide activation: such a layer
is one record, which goes to every salt, and a row's blocks stay together, so that its partial sums
are added where they are made, in the same order, and only whole rows are dealt, once for all these
layers up to CHAINED.

Input blocks are few, so they alone would be hot keys: rows are dealt over as many salts as the
shuffle has partitions, and each weight block goes to every salt. A layer of n rows, U units and I
inputs moves n * U * I / BLOCK partial sums; the rows' own columns wait beside it and are joined
back by row number at the end. Every layer's values (of such first layers, every CHAINED) are written to the shared scratch folder, so a lost
executor repeats one layer at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloscore.functions.activations import ACTIVATIONS, EPSILON, activation
from veloscore.functions.columns import any_missing, is_missing
from veloscore.operators.scoring import score
from veloscore.session import scratch_path
from veloscore.sources.model_table import (MAX_UNITS, MAX_WEIGHTS, NORMALISER_LAYER, load_model, model_size,
                                           read_model_table)

#: Inputs in one block of weights or values.
BLOCK = 256
#: Weights of a layer that is one record, and salts that it goes to for each shuffle partition.
TILE = 1 << 14
SPREAD = 4
#: Layers of one record each that are computed between two writes.
CHAINED = 8
#: Layers that one network may have: the driver plans a few jobs for each.
MAX_LAYERS = 1000

_ROW, _DATA = "__row", "__data"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _layers(table: DataFrame) -> tuple[list, object]:
    """One checked summary a layer (a row each reaches the driver), and the normaliser's if any."""
    act = F.col("activation")
    bad = F.exists("weights", lambda w: w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
    odd = F.coalesce(bad | is_missing(F.col("bias")) | ~act.isin(*ACTIVATIONS, "standardise", "minmax"), F.lit(True))
    rows = table.groupBy("layer").agg(
        F.count("*").alias("units"), F.countDistinct("unit").alias("distinct"), F.min("unit").alias("first"), F.max("unit").alias("last"),
        F.min(F.size("weights")).alias("narrow"), F.max(F.size("weights")).alias("inputs"), F.count_if(odd).alias("odd"),
        F.min("activation").alias("act"), F.max("activation").alias("other_act"),
        F.max(act.isin(*(a for a, x in ACTIVATIONS.items() if x.wide))).alias("wide")).orderBy("layer").limit(MAX_LAYERS + 2).collect()
    normaliser = rows.pop(0) if rows and rows[0]["layer"] == NORMALISER_LAYER else None
    if not rows:
        raise ValueError("the model table holds no layer")
    if len(rows) > MAX_LAYERS:
        raise ValueError(f"more than {MAX_LAYERS} layers")
    width = rows[0]["inputs"]
    for k, r in enumerate(rows):
        if r["layer"] != k:
            raise ValueError("layers are not numbered 0..n-1")
        if r["first"] != 0 or r["last"] != r["units"] - 1 or r["distinct"] != r["units"]:
            raise ValueError(f"layer {k} units are not numbered 0..n-1")
        if r["narrow"] != width or r["inputs"] != width:
            raise ValueError(f"layer {k} expects {width} inputs, has {r['narrow']} to {r['inputs']}")
        if r["odd"]:
            raise ValueError(f"layer {k} has non-finite weights or unknown activations in {r['odd']} units")
        if r["wide"] and r["act"] != r["other_act"]:
            raise ValueError(f"layer {k} mixes a layer-wide activation with others")
        width = r["units"]
    if normaliser and (normaliser["units"] != rows[0]["inputs"] or normaliser["inputs"] != 2):
        raise ValueError("the normaliser does not fit the first layer")
    return rows, normaliser


def _blocks_of(vector: Column, block: int) -> Column:
    """A vector's pieces as (at, part), each of ``block`` values."""
    starts = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / block).cast("int"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(vector, i * block + 1, F.lit(block)).alias("part")))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _activated(z: DataFrame, r) -> DataFrame:
    """(row, unit, z, activation) -> (row, unit, h)."""
    if not r["wide"]:
        h = None
        for name, a in ACTIVATIONS.items():
            if not a.wide:
                when = F.when if h is None else h.when
                h = when(F.col("activation") == name, F.expr(a.unit("z")))
        return z.select(_ROW, "unit", h.alias("h"))
    kind = activation(r["act"]).name
    if kind == "softmax":
        top = z.groupBy(_ROW).agg(F.max("z").alias("top"))
        e = z.join(top, _ROW).select(_ROW, "unit", F.exp(F.col("z") - F.col("top")).alias("e"))
        return e.join(e.groupBy(_ROW).agg(F.sum("e").alias("all")), _ROW).select(_ROW, "unit", (F.col("e") / F.col("all")).alias("h"))
    mean = z.groupBy(_ROW).agg(F.avg("z").alias("mean"))
    d = z.join(mean, _ROW).select(_ROW, "unit", (F.col("z") - F.col("mean")).alias("d"))
    root = d.groupBy(_ROW).agg(F.sqrt(F.avg(F.col("d") * F.col("d")) + F.lit(EPSILON)).alias("root"))
    return d.join(root, _ROW).select(_ROW, "unit", (F.col("d") / F.col("root")).alias("h"))


def _product(values: DataFrame, weights: DataFrame, salts: int, block: int) -> DataFrame:
    """(row, unit, z, activation) of one layer: values(row, at, part) times weights(unit, ...)."""
    cut = weights.select("unit", "bias", "activation", F.inline(_blocks_of(F.col("weights"), block)))
    cut = cut.withColumnRenamed("part", "w").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = values.withColumn("salt", F.pmod(F.xxhash64(_ROW), F.lit(salts)).cast("int"))
    # a merge join on both sides' blocks: the weights may be larger than any task
    partial = dealt.hint("merge").join(cut, ["at", "salt"]).select(_ROW, "unit", "bias", "activation", "at", _dot(F.col("part"), F.col("w")).alias("p"))
    parts = partial.groupBy(_ROW, "unit", "bias", "activation").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("ps"))
    return parts.select(_ROW, "unit", "activation", (F.aggregate("ps", F.lit(0.0), lambda acc, x: acc + x["p"]) + F.col("bias")).alias("z"))


def _tiled(rows: DataFrame, weights: DataFrame, salts: int, block: int) -> DataFrame:
    """(row, salt, x) of one layer whose weights are one record, from (row, salt, x): the same products, sums and
    activations as _product and _activated, all of a row where the row is."""
    blocks = weights.select("layer", "unit", "bias", "activation", F.inline(_blocks_of(F.col("weights"), block)))
    units = blocks.groupBy("layer", "unit", "bias", "activation").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("ws"))
    unit = F.struct("unit", "bias", "activation", F.transform("ws", lambda b: b["part"]).alias("w"))
    tile = units.groupBy("layer").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    tile = tile.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cut = rows.select(_ROW, "salt", F.transform(_blocks_of(F.col("x"), block), lambda b: b["part"]).alias("xs"))
    total = lambda ps: F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + p)
    z = F.transform("units", lambda u: F.struct(u["activation"].alias("act"), (total(F.zip_with("xs", u["w"], _dot)) + u["bias"]).alias("z")))
    kinds = " ".join(f"WHEN u.act = '{name}' THEN {a.unit('u.z')}" for name, a in ACTIVATIONS.items() if not a.wide)
    joined = cut.hint("merge").join(tile, "salt").select(_ROW, "salt", z.alias("zs"))
    return joined.select(_ROW, "salt", F.expr(f"transform(zs, u -> CASE {kinds} END)").alias("x"))


def _normalised(values: DataFrame, table: DataFrame, block: int, width: int) -> DataFrame:
    """values(row, at, part) with each feature shifted and scaled. The numbers, three a feature, are
    broadcast up to MAX_UNITS features."""
    rows = table.where(F.col("layer") == NORMALISER_LAYER)
    packed = rows.groupBy(F.floor(F.col("unit") / block).cast("int").alias("at")).agg(
        F.sort_array(F.collect_list(F.struct("unit", F.get("weights", F.lit(0)).alias("shift"), F.get("weights", F.lit(1)).alias("scale"), F.col("bias").alias("offset")))).alias("n"))
    changed = F.zip_with("part", "n", lambda x, n: (x - n["shift"]) * n["scale"] + n["offset"])
    packed = F.broadcast(packed) if width <= MAX_UNITS else packed
    return values.join(packed, "at").select(_ROW, "at", changed.alias("part"))


def score_relational(df: DataFrame, model: DataFrame | str, features_col: str = "features",
                     out_col: str = "prediction", model_id: str | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with the prediction of a model table (or the path of one), as joins and sums.

    As on the other routes, the output is DOUBLE for a one-output network, else ``ARRAY<DOUBLE>``; a
    missing feature gives NULL, and a vector of another width fails the job.
    """
    spark = df.sparkSession
    table = model if isinstance(model, DataFrame) else read_model_table(spark, model)
    if model_id is not None:
        table = table.where(F.col("model_id") == model_id)
    elif table.select("model_id").distinct().limit(2).count() != 1:
        raise ValueError("the model table holds no model or several; pass model_id")
    layers, normaliser = _layers(table)
    if layers[-1]["units"] > MAX_UNITS:
        raise ValueError(f"{layers[-1]['units']} outputs do not fit one row (limit {MAX_UNITS})")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = layers[0]["inputs"]
    vector = isinstance(df.schema[features_col].dataType, T.ArrayType)
    if not vector and width != 1:
        raise ValueError(f"the network takes {width} inputs; column {features_col!r} is a scalar")
    x = F.col(features_col).cast("array<double>") if vector else F.array(F.col(features_col).cast("double"))
    # rows get numbers once, in files, so that every later stage sees the same ones
    rows = _written(df.select("*", F.monotonically_increasing_id().alias(_ROW)), "relational-rows")
    if vector:
        message = F.concat(F.lit(f"feature vector width differs from the model input width {width}: got "), F.size(x).cast("string"))
        x = F.when(x.isNotNull() & (F.size(x) != width), F.raise_error(message)).otherwise(x)
    whole = rows.select(_ROW, x.alias("x")).where(~any_missing(F.col("x")))
    first = 0
    while normaliser is None and first < len(layers) and not layers[first]["wide"] and layers[first]["units"] * layers[first]["inputs"] <= TILE:
        if first % CHAINED == 0:
            whole = _written(whole.select(_ROW, "x"), f"relational-layer-{first - 1}") if first else whole
            whole = whole.withColumn("salt", F.pmod(F.xxhash64(_ROW), F.lit(SPREAD * salts)).cast("int"))
        whole = _tiled(whole, table.where(F.col("layer") == first), SPREAD * salts, block)
        first += 1
    values = whole.select(_ROW, F.inline(_blocks_of(F.col("x"), block)))
    if 0 < first < len(layers):
        values = _written(values, f"relational-layer-{first - 1}")
    if normaliser is not None:
        values = _normalised(values, table, block, width)
    for k, r in list(enumerate(layers))[first:]:
        z = _product(values, table.where(F.col("layer") == k), salts, block)
        if r["wide"]:
            z = _written(z, f"relational-sums-{k}")
        h = _activated(z, r)
        if k + 1 < len(layers):
            packed = h.groupBy(_ROW, F.floor(F.col("unit") / block).cast("int").alias("at")).agg(F.sort_array(F.collect_list(F.struct("unit", "h"))).alias("us"))
            values = _written(packed.select(_ROW, "at", F.transform("us", lambda u: u["h"]).alias("part")), f"relational-layer-{k}")
    if first == len(layers):
        out = whole.select(F.col(_ROW).alias(_DATA), (F.get("x", F.lit(0)) if layers[-1]["units"] == 1 else F.col("x")).alias("__out"))
    elif layers[-1]["units"] == 1:
        out = h.select(F.col(_ROW).alias(_DATA), F.col("h").alias("__out"))
    else:
        out = h.groupBy(_ROW).agg(F.sort_array(F.collect_list(F.struct("unit", "h"))).alias("us")).select(F.col(_ROW).alias(_DATA), F.transform("us", lambda u: u["h"]).alias("__out"))
    joined = rows.join(out, F.col(_ROW) == F.col(_DATA), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__out").alias(out_col))


def score_table(df: DataFrame, model: DataFrame | str, features_col: str = "features", out_col: str = "prediction",
                model_id: str | None = None, max_weights: int = MAX_WEIGHTS, max_units: int = MAX_UNITS) -> DataFrame:
    """Scores with a model table by its size: native columns or the UDF for a network that may be
    shipped, joins and sums for a larger one. No network is refused."""
    table = model if isinstance(model, DataFrame) else read_model_table(df.sparkSession, model)
    if model_id is not None:
        table = table.where(F.col("model_id") == model_id)
    units, weights = model_size(table)
    if units > max_units or weights > max_weights:
        return score_relational(df, table, features_col, out_col, model_id)
    return score(df, load_model(df.sparkSession, table, model_id), features_col, out_col, route="auto")
