"""The recurrent network as SQL text (DuckDB): a recursive query that takes one step of every
sequence at a time."""

from __future__ import annotations

from veloscore.functions.sql import lit, network_sql
from veloscore.sources.sequence_model import SequenceModel


def sequence_sql(model: SequenceModel, source_sql: str, key: str, order: list[str], x: str, carry: dict[str, str],
                 out: str = "prediction", out_expr: str = "{}") -> str:
    """SELECT ``carry`` (columns and their types) and ``out`` of every row of ``source_sql``; the key is
    not NULL here."""
    cell, n = model.cell, model.cell.hidden
    h = [f"h{u}" for u in range(n)]

    def gate(g: int, u: int, state: list[str]) -> str:
        k = g * n + u
        terms = [f"x * {lit(cell.inputs[k][0])}", lit(cell.bias[k])] + [f"{s} * {lit(w)}" for s, w in zip(state, cell.state[k], strict=True)]
        return "(" + " + ".join(terms) + ")"

    gates = ", ".join(f"(1 / (1 + exp(-{gate(g, u, h)}))) AS {name}{u}" for g, name in enumerate("zr") for u in range(n))
    passed = [f"(r{u} * h{u})" for u in range(n)]
    candidates = ", ".join(f"tanh({gate(2, u, passed)}) AS c{u}" for u in range(n))
    after = ", ".join(f"CASE WHEN gone THEN h{u} ELSE (1 - z{u}) * h{u} + z{u} * c{u} END AS h{u}" for u in range(n))
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS h{u}" for u in range(n))
    names = ", ".join(carry)
    step = (f"SELECT k, n, {names}, gone, {after} FROM (SELECT *, {candidates} FROM (SELECT *, {gates} FROM "
            f"(SELECT s.*, {', '.join(f'r.h{u}' for u in range(n))} FROM r JOIN s ON s.k = r.k AND s.n = r.n + 1) AS b) AS g) AS c")
    states = (f"WITH RECURSIVE s AS (SELECT {names}, {key} AS k, {x} IS NULL OR isnan({x}) AS gone, coalesce({x}, 0) AS x, "
              f"row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(order)}) AS n FROM {source_sql}), "
              f"r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, {', '.join(f'CAST(NULL AS {t}) AS {c}' for c, t in carry.items())}, false AS gone, {zeros} FROM s "
              f"UNION ALL {step}) "
              f"SELECT {names}, CASE WHEN gone THEN NULL ELSE [{', '.join(h)}] END AS state FROM r WHERE n > 0")
    return network_sql(model.head, f"({states})", "state", list(carry), out, vector=True, out_expr=out_expr)

