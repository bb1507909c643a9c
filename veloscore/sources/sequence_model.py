"""A recurrent network over ordered sequences: a gated cell, then dense layers on its state.

The cell keeps a state vector h, zero where a sequence begins. For a step's features x:

    z = sigmoid(Wz x + Uz h + bz)          how much of the state is replaced
    r = sigmoid(Wr x + Ur h + br)          how much of it the candidate sees
    c = tanh(Wc x + Uc (r * h) + bc)       the candidate
    h = (1 - z) * h + z * c

In a model table the cell is layer 0, three rows a state element: gate g of element u is unit
``g * hidden + u``, its ``weights`` are those of the features, then of the state, and its
``activation`` names the gate. The dense layers follow as layers 1..n.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from veloscore.sources.model_table import MAX_WEIGHTS, MODEL_SCHEMA, Model, model_size, read_model_table

GATES = ("gru_update", "gru_reset", "gru_candidate")


@dataclass(frozen=True)
class Cell:
    """Weights of the features (3 * hidden, inputs), of the state (3 * hidden, hidden), and biases,
    gate after gate."""

    inputs: np.ndarray
    state: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.state.shape[1]

    @property
    def width(self) -> int:
        return self.inputs.shape[1]

    def step(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One step of many sequences: states (n, hidden) and features (n, width)."""
        n = self.hidden
        from_x = x @ self.inputs.T + self.bias
        gates = 1.0 / (1.0 + np.exp(-(from_x[:, :2 * n] + h @ self.state[:2 * n].T)))
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(from_x[:, 2 * n:] + (r * h) @ self.state[2 * n:].T)
        return (1.0 - z) * h + z * c


@dataclass(frozen=True)
class SequenceModel:
    model_id: str
    cell: Cell
    head: Model

    @staticmethod
    def build(model_id: str, inputs, state, bias, head: list) -> "SequenceModel":
        cell = Cell(*(np.asarray(a, np.float64) for a in (inputs, state, bias)))
        if cell.inputs.ndim != 2 or cell.state.ndim != 2 or cell.state.shape[0] != 3 * cell.hidden or cell.hidden == 0:
            raise ValueError(f"model {model_id!r}: a cell has three gates of one state")
        if cell.inputs.shape[0] != 3 * cell.hidden or cell.width == 0 or cell.bias.shape != (3 * cell.hidden,):
            raise ValueError(f"model {model_id!r}: the cell's weights and biases differ in number")
        if not all(np.isfinite(a).all() for a in (cell.inputs, cell.state, cell.bias)):
            raise ValueError(f"model {model_id!r}: the cell has a non-finite weight")
        dense = Model.build(model_id, head)
        if dense.n_inputs != cell.hidden:
            raise ValueError(f"model {model_id!r}: the state has {cell.hidden} elements, the next layer takes {dense.n_inputs}")
        return SequenceModel(model_id, cell, dense)

    def rows(self) -> list[tuple]:
        c, n = self.cell, self.cell.hidden
        own = [(self.model_id, 0, u, [float(w) for w in (*c.inputs[u], *c.state[u])], float(c.bias[u]), GATES[u // n]) for u in range(3 * n)]
        return own + [(m, layer + 1, *rest) for m, layer, *rest in self.head.rows()]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), MODEL_SCHEMA)

    @staticmethod
    def from_rows(model_id: str, rows) -> "SequenceModel":
        cell = sorted((r for r in rows if r["layer"] == 0), key=lambda r: r["unit"])
        n = len(cell) // 3
        if not n or [(r["unit"], r["activation"]) for r in cell] != [(u, GATES[u // n]) for u in range(3 * n)]:
            raise ValueError(f"model {model_id!r}: layer 0 is no recurrent cell")
        weights = np.array([list(r["weights"]) for r in cell], np.float64)
        head = [{**r.asDict(), "layer": r["layer"] - 1} for r in rows if r["layer"] != 0]
        dense = Model.from_rows(model_id, head)
        return SequenceModel.build(model_id, weights[:, :-n], weights[:, -n:], [r["bias"] for r in cell],
                                   [(layer.weights, layer.bias, layer.activation) for layer in dense.layers])


def load_sequence_model(spark: SparkSession, path: str | DataFrame, model_id: str, max_weights: int = MAX_WEIGHTS) -> SequenceModel:
    """One recurrent network from a model table, with a size-checked, bounded collect."""
    table = path if isinstance(path, DataFrame) else read_model_table(spark, path)
    table = table.where(table.model_id == model_id)
    if model_size(table)[1] > max_weights:
        raise ValueError(f"model {model_id!r} is over the limit of {max_weights} weights")
    return SequenceModel.from_rows(model_id, table.collect())


# Dyadic weights, as those of the other demo networks.
def demo_sequence_model() -> SequenceModel:
    """``demo-gru-1-2-1``: one feature a step, two state elements, one linear output."""
    return SequenceModel.build(
        "demo-gru-1-2-1", [[0.03125], [-0.015625], [0.0625], [0.03125], [0.0625], [-0.03125]],
        [[0.25, -0.5], [0.5, 0.25], [-0.25, 0.5], [0.125, 0.25], [0.75, -0.25], [0.5, 0.5]],
        [-1.0, -0.5, 0.25, -0.25, -0.5, 0.75], [([[32.0, -16.0]], [8.0], "linear")])
