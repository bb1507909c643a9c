"""The one table of activations: how each is written in SQL (Spark and DuckDB alike) and in numpy.

Most act on one unit. Some need every unit of their layer (``softmax``, ``normalise``): in SQL these
are a few projections after each other, so nothing is evaluated twice. Softmax takes the greatest
unit away first, so no logit is too large for ``exp``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Added to a layer's variance before it is divided by its root.
EPSILON = 1e-5

_ZERO, _ONE = "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"

#: Steps of a layer-wide activation: each a list of (column, expression) over earlier columns.
Steps = list[list[tuple[str, str]]]


@dataclass(frozen=True)
class Activation:
    name: str
    #: On a (batch, units) matrix; a layer-wide one sees all units of its layer.
    numpy: Callable[[np.ndarray], np.ndarray]
    #: With ``{z}`` for the unit, if it acts on one.
    sql: str | None = None
    #: (units' columns, prefix of new ones) -> steps, the last of which are the outputs, if it is wide.
    steps: Callable[[list[str], str], Steps] | None = None

    @property
    def wide(self) -> bool:
        return self.steps is not None

    def unit(self, z: str) -> str:
        if self.sql is None:
            raise ValueError(f"activation {self.name!r} needs every unit of its layer")
        return self.sql.format(z=z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _normalise(z: np.ndarray) -> np.ndarray:
    apart = z - z.mean(axis=1, keepdims=True)
    return apart / np.sqrt((apart * apart).mean(axis=1, keepdims=True) + EPSILON)


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _softmax_steps(z: list[str], p: str) -> Steps:
    top = f"greatest({', '.join(z)})" if len(z) > 1 else z[0]
    e = [f"{p}_e{i}" for i in range(len(z))]
    return [[(f"{p}_top", top)], [(c, f"exp({x} - {p}_top)") for c, x in zip(e, z, strict=True)],
            [(f"{p}_sum", _sum(e))], [(f"{p}_{i}", f"({c} / {p}_sum)") for i, c in enumerate(e)]]


def _normalise_steps(z: list[str], p: str) -> Steps:
    d = [f"{p}_d{i}" for i in range(len(z))]
    return [[(f"{p}_mean", f"({_sum(z)} / CAST({len(z)} AS DOUBLE))")],
            [(c, f"({x} - {p}_mean)") for c, x in zip(d, z, strict=True)],
            [(f"{p}_root", f"sqrt({_sum([f'({c} * {c})' for c in d])} / CAST({len(z)} AS DOUBLE) + CAST({EPSILON!r} AS DOUBLE))")],
            [(f"{p}_{i}", f"({c} / {p}_root)") for i, c in enumerate(d)]]


ACTIVATIONS: dict[str, Activation] = {a.name: a for a in (
    Activation("linear", lambda z: z, "{z}"),
    Activation("relu", lambda z: np.maximum(z, 0.0), f"greatest({_ZERO}, {{z}})"),
    Activation("sigmoid", _sigmoid, f"({_ONE} / ({_ONE} + exp(-({{z}}))))"),
    Activation("tanh", np.tanh, "tanh({z})"),
    Activation("softmax", _softmax, steps=_softmax_steps),
    Activation("normalise", _normalise, steps=_normalise_steps),
)}


def activation(name: str) -> Activation:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}")
    return ACTIVATIONS[name]


def activate(z: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """A layer's activations, one a unit, on a (batch, units) matrix."""
    if len(set(names)) == 1:
        return activation(names[0]).numpy(z)
    out = np.empty_like(z)
    for name in set(names):
        units = [i for i, a in enumerate(names) if a == name]
        out[:, units] = activation(name).numpy(z[:, units])
    return out
