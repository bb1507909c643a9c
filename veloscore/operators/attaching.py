"""M2: a network attached to the cluster, held once by each Python worker.

Tasks come and go, the workers that run them stay. A worker keeps the predictors it has made, by the
name of what they were made from, so that a network is read and built once a worker and not once a
task. An attached network is named by its table's path, its id and a fingerprint of its rows: a table
that was written anew under the same path is another network. Workers read the table themselves, from
the shared storage that it was published to; the driver reads only its shape and fingerprint.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass

import numpy as np
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscore.operators.scoring import score_batched
from veloscore.sources.model_table import (MAX_UNITS, MAX_WEIGHTS, NORMALISER_LAYER, Model,
                                           model_size, read_model_table)

#: Predictors that a worker keeps; beyond it the one unused for longest goes.
MAX_HELD = 8

_HELD: OrderedDict[Hashable, Callable] = OrderedDict()


def held(name: Hashable, make: Callable[[], Callable]) -> Callable:
    """This process's predictor of that name, made on first use."""
    if name in _HELD:
        _HELD.move_to_end(name)
        return _HELD[name]
    predictor = _HELD[name] = make()
    while len(_HELD) > MAX_HELD:
        _HELD.popitem(last=False)
    return predictor


@dataclass(frozen=True)
class Attached:
    """What the driver knows of an attached network."""

    path: str
    model_id: str
    fingerprint: int
    n_inputs: int
    n_outputs: int

    @property
    def name(self) -> tuple:
        return (self.path, self.model_id, self.fingerprint)

    def read(self) -> Model:
        """The network, read where this is called."""
        files, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        table = ds.dataset(path, filesystem=files, format="parquet").to_table(filter=ds.field("model_id") == self.model_id)
        return Model.from_rows(self.model_id, table.select(["layer", "unit", "weights", "bias", "activation"]).to_pylist())


def attach(spark: SparkSession, path: str, model_id: str, max_units: int = MAX_UNITS, max_weights: int = MAX_WEIGHTS) -> Attached:
    """Attaches a published network: checks its size, takes its shape and fingerprint."""
    table = read_model_table(spark, path).where(F.col("model_id") == model_id)
    units, weights = model_size(table)
    if not units:
        raise ValueError(f"model {model_id!r} not found")
    if units > max_units or weights > max_weights:
        raise ValueError(f"model {model_id!r} has {units} units / {weights} weights, over the limit "
                         f"({max_units} / {max_weights}) for a worker; score it from its table with score_relational")
    rows = table.where(F.col("layer") != NORMALISER_LAYER)
    first = F.max(F.when(F.col("layer") == 0, F.size("weights")))
    shape = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("units"), first.alias("inputs")).agg(
        F.max("inputs").alias("n_inputs"), F.max_by("units", "layer").alias("n_outputs")).first()
    mark = F.xxhash64("layer", "unit", F.col("weights").cast("string"), "bias", "activation")
    return Attached(path, model_id, table.agg(F.bit_xor(mark)).first()[0], shape["n_inputs"], shape["n_outputs"])


def _predictor(attached: Attached) -> Callable:
    model = attached.read()

    def predict(x):
        h = model.forward(np.asarray(x, dtype=np.float64).reshape(-1, model.n_inputs))
        return h[:, 0] if model.n_outputs == 1 else h

    return predict


def score_attached(df: DataFrame, attached: Attached, features_col: str = "features", out_col: str = "prediction",
                   batch_size: int = 5, make_predictor: Callable[[Attached], Callable] = _predictor) -> DataFrame:
    """Route A with an attached network. ``make_predictor`` (the network's own forward pass by
    default) runs once in each worker process, however many tasks it runs."""
    def make_predict_fn():
        return held(attached.name, lambda: make_predictor(attached))

    return score_batched(df, attached, features_col, out_col, batch_size, make_predict_fn)
