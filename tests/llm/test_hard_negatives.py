"""Hard negatives against plain loops and SQL, and the trees' bounds against all pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veloscore.llm import hard_negatives as hn


def brute(rows):
    """rows: (vec_id, vector, label)."""
    some = [(i, [int(np.floor(256 * np.float64(x))) for x in v], (la + 1) % 10 if i is not None and i % 7 == 0 else la)
            for i, v, la in rows if la is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for a, (i, v, la) in enumerate(some):
        if i is None or i % 100:
            continue
        scored = [(j, sum(x * y for x, y in zip(v, u, strict=True)), lb == la) for c, (j, u, lb) in enumerate(some) if c != a and len(u) == len(v)]
        for p, ps, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            fit = sorted((s for s in scored if not s[2] and 80 * ps <= 100 * s[1] <= 100 * ps), key=order)[:5]
            out += [(i, p, k, n, ps, ns) for k, (n, ns, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def cloud(seed, n, width=6, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, width))
    x = centres[draw.integers(0, 8, n)] + spread * draw.normal(size=(n, width))
    x[: n // 4] = x[0]  # copies
    x[n // 4: n // 2] *= draw.uniform(0.1, 3, (n // 2 - n // 4, 1))  # of many lengths
    return x


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    for name in ("rid", "cls", "width", "cell", "score", "place", "copies"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def got(df):
    return sorted(map(tuple, hn.mine(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "BLOCK", 40)  # many cells and blocks
    monkeypatch.setattr(hn, "CHUNK", 3)
    x = cloud(seed, 400)
    draw = np.random.default_rng(seed)
    labels = draw.integers(0, 4, 400)
    rows = [(int(25 * i) % 9000, x[i].tolist(), int(labels[i])) for i in range(400)]
    assert got(table(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25, 0.0]
    rows = [(0, v, 1), (0, v, 1), (100, v, 1), (100, [0.5, 0.2, 0.1], 2), (None, v, 1), (None, v, 2), (200, [0.0, 0.0, 0.0], 3), (300, [-0.5, 0.1, 0.0], 3),
            (400, v, None), (500, None, 1), (600, [], 1), (700, [nan, 0.0, 0.0], 1), (800, [inf, 0.0, 0.0], 1), (900, [None, 0.0, 0.0], 1),
            (1000, [0.5, 0.5], 1), (1001, [0.5, 0.4], 1), (1002, [0.5, 0.45], 2), (1, v, 2), (1, v, 2), (2, [0.49, 0.25, 0.0], 2), (3, [0.0, 0.0, 0.0], 1)]
    rows += [(10 + i, v, 1) for i in range(9)] + [(50 + i, v, 4) for i in range(9)]
    df = table(spark, rows)
    assert got(df) == brute(rows)
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding", "label").toArrow())
    assert got(df) == sorted(con.sql(hn.ORACLE).fetchall(), key=repr)
    assert got(df.limit(0)) == []
    assert got(df.where("embedding is null")) == []


@pytest.mark.parametrize("seed", range(6))
def test_descent_finds_what_all_pairs_find(seed):
    x = np.floor(256 * cloud(seed, 300))
    x = np.unique(x, axis=0)
    draw = np.random.default_rng(seed)
    greatest = float(np.sqrt((x ** 2).sum(1).max()))
    label = draw.integers(0, 3, len(x))
    ids = [list(range(int(k))) for k in draw.integers(1, 7, len(x))]
    query = np.floor(256 * cloud(seed + 50, 40))
    most = np.where(draw.random(40) < 0.5, (1 << 62), draw.integers(0, 60000, 40))
    least = np.where(draw.random(40) < 0.5, hn.NONE, most // 2)
    for same in (True, False):
        asked = hn.Requests(query, draw.integers(0, 3, 40), least, most, np.full(40, hn.NONE), same)
        r, f, s = hn.descend(hn.Leaves(x, label, ids, hn.Tree(hn._unit(x, greatest))), asked, greatest)
        for k in range(40):
            scores = query[k] @ x.T
            fits = ((label == asked.label[k]) == same) & (scores >= least[k]) & (scores <= most[k])
            rows = sorted((-scores[i] for i in np.flatnonzero(fits) for _ in ids[i]))[:hn.PER_CLASS]
            mine = sorted(-v for i, v in zip(f[r == k].tolist(), s[r == k].tolist(), strict=True) for _ in ids[i])[:hn.PER_CLASS]
            assert mine == rows


def test_tree_covers_and_skips():
    x = np.unique(np.floor(256 * cloud(3, 2000, spread=0.01)), axis=0)
    greatest = float(np.sqrt((x ** 2).sum(1).max()))
    unit = hn._unit(x, greatest)
    assert np.allclose(np.linalg.norm(unit, axis=1), 1)
    tree = hn.Tree(unit)
    assert sorted(tree.centre[-1].tolist()) == list(range(len(x)))
    for k in range(len(tree.child)):  # nested: a node's centre is one of its children's
        for i in range(len(tree.centre[k])):
            assert tree.centre[k][i] in tree.centre[k + 1][tree.child[k][i]:tree.child[k][i + 1]]
    scored = []
    plain = hn._integers
    try:
        hn._integers = lambda a, b: (Counting(a, scored), b)
        n = 5
        top = np.full(n, 1 << 62)
        hn.descend(hn.Leaves(x, np.zeros(len(x), int), [[0]] * len(x), tree), hn.Requests(x[:n], np.zeros(n, int), np.full(n, hn.NONE), top, np.full(n, hn.NONE), True), greatest)
    finally:
        hn._integers = plain
    assert sum(scored) < 0.5 * n * len(x)  # leaves of far clusters are never scored


class Counting(np.ndarray):
    """Vectors that note how many inner products they take part in."""

    def __new__(cls, values, seen):
        out = np.asarray(values).view(cls)
        out.seen = seen
        return out

    def __array_finalize__(self, other):
        self.seen = getattr(other, "seen", None)

    def __matmul__(self, other):
        self.seen.append(len(self) * other.shape[1])
        return np.asarray(self) @ other


def test_scores_that_do_not_fit_raise():
    with pytest.raises(ValueError):
        hn._integers(np.array([[1e12]]), np.array([[1e12]]))
    a, b = hn._integers(np.array([[2.0 ** 30]]), np.array([[2.0 ** 30]]))
    assert (a @ b.T)[0, 0] == 1 << 60


def test_small_types_keep_values():
    for top in (5, 40000, 2 ** 33):
        assert hn._small(np.array([[top, -top]], float)).astype(float).tolist() == [[top, -top]]
