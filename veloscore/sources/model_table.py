"""Model table (S3, S4): a feed-forward network stored as a Parquet table.

One row per unit: ``model_id, layer, unit, weights ARRAY<DOUBLE>, bias, activation``. ``weights``
has one entry per input of the layer (the previous layer's units, or the feature width for
layer 0). A network is loaded with one bounded collect whose size is checked first; one that is
larger is scored from its table (:mod:`veloscore.operators.relational`).

A normaliser is stored with its network as layer -1, one row a feature: ``weights`` are the shift
and the scale, ``bias`` what is added after, ``activation`` the kind. A recurrent cell is layer 0 of
a sequence network (:mod:`veloscore.sources.sequence_model`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscore.functions.activations import ACTIVATIONS, activate

MODEL_SCHEMA = ("model_id STRING, layer INT, unit INT, weights ARRAY<DOUBLE>, bias DOUBLE, "
                "activation STRING")

#: The layer number under which a network's normaliser is stored, and its kinds.
NORMALISER_LAYER = -1
NORMALISERS = ("standardise", "minmax")

#: Largest network ``load_model`` will pull to the driver (units, weights). The weights are
#: shipped with every scoring task, so they must stay small next to an executor's memory.
MAX_UNITS = 100_000
MAX_WEIGHTS = 20_000_000


@dataclass(frozen=True)
class Layer:
    weights: np.ndarray          # (units, inputs), float64
    bias: np.ndarray             # (units,)
    activation: tuple[str, ...]  # one per unit

    @property
    def n_units(self) -> int:
        return self.weights.shape[0]

    @property
    def n_inputs(self) -> int:
        return self.weights.shape[1]


@dataclass(frozen=True)
class Normaliser:
    """Features to ``(x - shift) * scale + offset``, one shift and scale a feature. A scale of 0
    stands for a feature that was constant or had no value: it becomes the offset."""

    kind: str
    shift: np.ndarray
    scale: np.ndarray
    offset: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) * self.scale + self.offset

    def validate(self, width: int) -> None:
        if self.kind not in NORMALISERS:
            raise ValueError(f"unknown normaliser {self.kind!r}")
        if self.shift.shape != (width,) or self.scale.shape != (width,):
            raise ValueError(f"normaliser of {len(self.shift)} features, the network takes {width}")
        if not (np.isfinite(self.shift).all() and np.isfinite(self.scale).all() and np.isfinite(self.offset)):
            raise ValueError("normaliser has a non-finite value")


@dataclass(frozen=True)
class Model:
    model_id: str
    layers: tuple[Layer, ...]
    normaliser: Normaliser | None = None

    @property
    def n_inputs(self) -> int:
        return self.layers[0].n_inputs

    @property
    def n_outputs(self) -> int:
        return self.layers[-1].n_units

    @property
    def n_weights(self) -> int:
        return sum(layer.weights.size for layer in self.layers)

    @staticmethod
    def build(model_id: str, layers: list[tuple[list[list[float]], list[float], str | list[str]]]
              ) -> "Model":
        """``layers`` = [(weights per unit, bias per unit, activation or one per unit), ...]."""
        out = []
        for weights, bias, act in layers:
            w = np.asarray(weights, dtype=np.float64)
            acts = (act,) * w.shape[0] if isinstance(act, str) else tuple(act)
            out.append(Layer(w, np.asarray(bias, dtype=np.float64), acts))
        model = Model(model_id, tuple(out))
        model.validate()
        return model

    def validate(self) -> None:
        if not self.layers:
            raise ValueError(f"model {self.model_id!r} has no layers")
        width = self.layers[0].n_inputs
        for i, layer in enumerate(self.layers):
            if layer.weights.ndim != 2 or layer.n_inputs != width or layer.n_units == 0:
                raise ValueError(f"model {self.model_id!r}: layer {i} expects {width} inputs, "
                                 f"has weights of shape {layer.weights.shape}")
            if layer.bias.shape != (layer.n_units,) or len(layer.activation) != layer.n_units:
                raise ValueError(f"model {self.model_id!r}: layer {i} bias/activation count")
            if not (np.isfinite(layer.weights).all() and np.isfinite(layer.bias).all()):
                raise ValueError(f"model {self.model_id!r}: layer {i} has a non-finite weight")
            bad = set(layer.activation) - set(ACTIVATIONS)
            if bad:
                raise ValueError(f"model {self.model_id!r}: unknown activation(s) {sorted(bad)}")
            if len(set(layer.activation)) > 1 and any(ACTIVATIONS[a].wide for a in layer.activation):
                raise ValueError(f"model {self.model_id!r}: layer {i} mixes a layer-wide activation with others")
            width = layer.n_units
        if self.normaliser is not None:
            self.normaliser.validate(self.n_inputs)

    def with_normaliser(self, normaliser: Normaliser | None, model_id: str | None = None) -> "Model":
        """This network behind a normaliser of its features."""
        model = Model(model_id or self.model_id, self.layers, normaliser)
        model.validate()
        return model

    def rows(self) -> list[tuple]:
        n = self.normaliser
        before = [] if n is None else [
            (self.model_id, NORMALISER_LAYER, i, [float(n.shift[i]), float(n.scale[i])], float(n.offset), n.kind)
            for i in range(len(n.shift))]
        return before + [(self.model_id, li, u, [float(w) for w in layer.weights[u]],
                          float(layer.bias[u]), layer.activation[u])
                         for li, layer in enumerate(self.layers) for u in range(layer.n_units)]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), MODEL_SCHEMA)

    @staticmethod
    def from_rows(model_id: str, rows) -> "Model":
        by_layer: dict[int, dict[int, tuple]] = {}
        for r in rows:
            by_layer.setdefault(int(r["layer"]), {})[int(r["unit"])] = r
        normaliser = _normaliser_of(model_id, by_layer.pop(NORMALISER_LAYER, None))
        if sorted(by_layer) != list(range(len(by_layer))):
            raise ValueError(f"model {model_id!r}: layers are not numbered 0..n-1")
        layers = []
        for li in range(len(by_layer)):
            units = by_layer[li]
            if sorted(units) != list(range(len(units))):
                raise ValueError(f"model {model_id!r}: layer {li} units are not numbered 0..n-1")
            ordered = [units[u] for u in range(len(units))]
            widths = {len(r["weights"]) for r in ordered}
            if len(widths) != 1:
                raise ValueError(f"model {model_id!r}: layer {li} has ragged weight arrays")
            layers.append(([list(r["weights"]) for r in ordered], [r["bias"] for r in ordered],
                           [r["activation"] for r in ordered]))
        return Model.build(model_id, layers).with_normaliser(normaliser)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Dense forward pass on a (batch, inputs) float64 matrix; returns (batch, outputs)."""
        h = x if self.normaliser is None else self.normaliser.apply(x)
        for layer in self.layers:
            h = activate(h @ layer.weights.T + layer.bias, layer.activation)
        return h


def _normaliser_of(model_id: str, rows: dict[int, tuple] | None) -> Normaliser | None:
    if not rows:
        return None
    if sorted(rows) != list(range(len(rows))):
        raise ValueError(f"model {model_id!r}: normaliser features are not numbered 0..n-1")
    ordered = [rows[i] for i in range(len(rows))]
    kinds, offsets = {r["activation"] for r in ordered}, {r["bias"] for r in ordered}
    if len(kinds) != 1 or len(offsets) != 1 or any(len(r["weights"]) != 2 for r in ordered):
        raise ValueError(f"model {model_id!r}: normaliser rows differ in kind, offset or shape")
    shift, scale = (np.array([r["weights"][k] for r in ordered], np.float64) for k in (0, 1))
    return Normaliser(kinds.pop(), shift, scale, float(offsets.pop()))


def publish_model(model: Model | DataFrame, path: str, spark: SparkSession | None = None) -> str:
    """Write a model table. A new model is a new path; an existing path is an error."""
    # A network that the driver holds is a few rows, one small file; a table keeps its partitions.
    df = model if isinstance(model, DataFrame) else model.to_frame(spark).coalesce(1)
    df.write.mode("errorifexists").parquet(path)
    return path


def read_model_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(path)


def load_model(spark: SparkSession, path: str | DataFrame, model_id: str | None = None,
               max_units: int = MAX_UNITS, max_weights: int = MAX_WEIGHTS) -> Model:
    """S3: load one network from a model table with a size-checked, bounded collect."""
    table = path if isinstance(path, DataFrame) else read_model_table(spark, path)
    if model_id is None:
        ids = [r[0] for r in table.select("model_id").distinct().limit(2).collect()]
        if len(ids) != 1:
            raise ValueError(f"model table holds {len(ids)} or more models; pass model_id")
        model_id = ids[0]
    table = table.where(F.col("model_id") == model_id)
    units, weights = model_size(table)
    if units == 0:
        raise ValueError(f"model {model_id!r} not found")
    if units > max_units or weights > max_weights:
        raise ValueError(f"model {model_id!r} has {units} units / {weights} "
                         f"weights, over the limit ({max_units} / {max_weights}) for shipping "
                         "with each task; score it from its table with score_relational")
    rows = table.select("layer", "unit", "weights", "bias", "activation").collect()
    return Model.from_rows(model_id, rows)


def model_size(table: DataFrame) -> tuple[int, int]:
    """Units and weights of a model table, by one small aggregate."""
    size = table.agg(F.count(F.lit(1)).alias("units"),
                     F.coalesce(F.sum(F.size("weights")), F.lit(0)).alias("weights")).first()
    return size["units"], size["weights"]


# ---------------------------------------------------------------------------------------------
# Demo models. The weights are dyadic fractions, so they are exact in binary and
# Spark, numpy and DuckDB agree on every product.
# ---------------------------------------------------------------------------------------------

def demo_scalar_model() -> Model:
    """``demo-1-3-1``: one input, three ReLU units, one linear output."""
    return Model.build("demo-1-3-1", [
        ([[0.5], [-0.25], [0.75]], [1.5, 20.0, -3.0], "relu"),
        ([[0.5, 0.125, 0.75]], [-0.5], "linear"),
    ])


def demo_multi_model() -> Model:
    """``demo-4-2-1``: four inputs, two ReLU units, one linear output. Weights in quarter steps:
    with two-decimal inputs every exact result has at most six decimals, so ``round(x, 8)``
    never meets a tie that engines break differently."""
    return Model.build("demo-4-2-1", [
        ([[0.25, -0.5, 0.5, 1.0], [-0.5, 0.25, 0.75, -0.75]], [1.0, 2.0], "relu"),
        ([[0.75, -0.25]], [0.5], "linear"),
    ])


# Numerators of the 64 weights (each divided by 64) of ``demo-64-1``.
DEMO_VECTOR_NUMERATORS = [
    3, -5, 8, 1, -2, 7, -9, 4, 6, -1, 2, -8, 5, 9, -3, 0,
    1, 4, -6, 7, -4, 2, 3, -7, 8, -5, 6, 1, -2, 9, -8, 5,
    -3, 2, 7, -1, 4, -9, 6, 3, -6, 8, -4, 1, 5, -2, 9, -7,
    2, -3, 1, 6, -8, 4, 7, -5, 3, -1, 8, -6, 2, 5, -9, 4,
]
DEMO_VECTOR_BIAS = 0.25


def demo_vector_model() -> Model:
    """``demo-64-1``: 64 inputs, one linear unit."""
    return Model.build("demo-64-1", [
        ([[n / 64 for n in DEMO_VECTOR_NUMERATORS]], [DEMO_VECTOR_BIAS], "linear"),
    ])


def demo_class_model() -> Model:
    """``demo-64-4-3``: 64 inputs, four linear units normalised together, three classes by softmax."""
    n = len(DEMO_VECTOR_NUMERATORS)
    first = [[DEMO_VECTOR_NUMERATORS[(i * (2 * u + 1) + u) % n] / 16 for i in range(n)] for u in range(4)]
    return Model.build("demo-64-4-3", [
        (first, [0.25, -0.5, 0.0, 0.75], "normalise"),
        ([[0.5, -0.25, 1.0, 0.125], [-0.75, 0.5, 0.25, 0.25], [0.25, 0.75, -0.5, -0.125]], [0.0, 0.125, -0.25], "softmax"),
    ])
