"""The network as SQL text, for the DuckDB oracle (and for ``spark.sql`` users).

Same expression order as :func:`veloscore.operators.scoring.score_native`: per unit
``((x0*w0 + x1*w1) + ...) + b``, then the activation; one nested SELECT per layer.
"""

from __future__ import annotations

from veloscore.functions.activations import activation
from veloscore.sources.model_table import Model


def lit(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _dot(inputs: list[str], w) -> str:
    acc = None
    for xi, wi in zip(inputs, w):
        term = f"({xi} * {lit(wi)})"
        acc = term if acc is None else f"({acc} + {term})"
    return acc


def missing_sql(x: str, vector: bool) -> str:
    if not vector:
        return f"({x} IS NULL OR isnan({x}))"
    return (f"({x} IS NULL OR list_bool_or(list_transform({x}, lambda v: v IS NULL OR isnan(v))))")


def network_sql(model: Model, source_sql: str, x: str, carry: list[str], out: str = "prediction",
                vector: bool = False, out_expr: str = "{}") -> str:
    """SELECT ``carry`` columns and ``out`` = the network applied to expression ``x`` over
    ``source_sql`` (a table name or a parenthesised query). ``out_expr`` wraps the raw output,
    e.g. ``'round({}, 8)'``. Missing features give NULL."""
    carry_sql = ", ".join(carry)
    feats = (f"CAST({x} AS DOUBLE[])" if vector else f"CAST({x} AS DOUBLE)")
    q = f"SELECT {carry_sql}, {feats} AS __x FROM {source_sql}"
    if vector:
        inputs = [f"__x[{i + 1}]" for i in range(model.n_inputs)]
    else:
        inputs = ["__x"]
    if model.normaliser is not None:
        n = model.normaliser
        inputs = [f"(({x} - {lit(n.shift[i])}) * {lit(n.scale[i])} + {lit(n.offset)})" for i, x in enumerate(inputs)]
    prev = ["__x"]
    for li, layer in enumerate(model.layers):
        names = [f"__h{li}_{u}" for u in range(layer.n_units)]
        sums = [f"({_dot(inputs, layer.weights[u])} + {lit(layer.bias[u])})" for u in range(layer.n_units)]
        acts = [activation(a) for a in layer.activation]
        keep = ", ".join([*carry, "__x"])
        if acts[0].wide:
            sum_names = [f"__z{li}_{u}" for u in range(layer.n_units)]
            steps = [list(zip(sum_names, sums, strict=True)), *acts[0].steps(sum_names, f"__h{li}")]
        else:
            steps = [[(n, a.unit(z)) for n, a, z in zip(names, acts, sums, strict=True)]]
        for k, step in enumerate(steps):
            new = ", ".join(f"{e} AS {n}" for n, e in step)
            q = f"SELECT {'*' if k else keep}, {new} FROM ({q}) AS __l{li}_{k}"
        inputs = names
        prev = names
    raw = prev[0] if model.n_outputs == 1 else f"[{', '.join(prev)}]"
    wrapped = out_expr.format(raw)
    return (f"SELECT {carry_sql}, CASE WHEN {missing_sql('__x', vector)} THEN NULL "
            f"ELSE {wrapped} END AS {out} FROM ({q}) AS __net")
