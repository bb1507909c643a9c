"""Exact embedding near-duplicates by dual traversal of cover trees.

Vectors are scaled to length 1, where a cosine of ``c`` is a Euclidean distance of
sqrt(2 - 2c). Equal vectors are one class, counted once with its number of rows. Classes are dealt
to cells by the nearest of a bounded number of pivots, and cells into blocks of bounded size; cells
whose vectors are there often are joined by class first, the others in the task of their block. Each
block is a cover tree, built once: nested levels of centres, radii halved from level to level, every
node with the true distance to its farthest member. Pairs of cells, then pairs of blocks, whose balls
lie farther apart than the threshold are dropped before any vector is read. Two trees (or one with
itself) are searched from the root down: a pair of nodes whose balls lie farther apart than
the threshold is pruned, a pair whose balls lie wholly within it links all its members at once, and
the rest splits into pairs of children, down to single vectors, whose cosine is computed in double
precision. Bounds are used only if they hold by more than rounding error.

Blocks are planted in files of bounded size, one a group, in the shared folder. A task reads one group
and, block by block, some of those that it meets, straight from their files: vectors are dealt once (or,
where they repeat, twice), saved once, and never copied for a pair, so disk grows with the vectors. A task gives
back, for each class, how many rows it links with, and a spanning forest of what it linked, so a group
of copies of any size costs rows in proportion to its members and not to its pairs. The driver gets the
pivots and the cells' numbers and radii, all of bounded size, and which groups meet.
Vectors in general position cannot be pruned above their own scale, which is why the work and what is
read, though not the disk, grow with the number of block pairs that the bounds leave. The table is read
several times, and must be the same each time.

Null, empty and zero vectors, and those that hold null or non-finite components, link with nothing.
Vectors of different lengths never link. Repeated rows and equal vectors under other ids link; rows
sharing a vec_id are rows of their own. A null vec_id never names a component unless all its rows
are null. Extra columns are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
import pickle
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from veloscore.session import checkpoint_root

from . import words as w
from .blocks import parts, written
from .components import connected_components

COSINE = 0.9
#: Distinct vectors in one tree.
BLOCK = 4096
#: Pivots for vectors of one length, which every task of one stage holds, and vectors drawn for each, of
#: which the driver chooses.
PIVOTS = 1024
DRAWN = 8
#: Bytes of blocks that are one file, and what a class takes in it beside its vector.
GROUP = 8 << 20
BESIDES = 48
#: Rows of a cell that are no more than so many times its classes go to their block as they are.
AGAIN = 1.25
#: Groups that one task meets its own with, and tasks that one job holds.
MET = 16
JOB = 128
#: What rounding can add to a distance between vectors of length 1.
SLACK = 1e-6
#: A level has hardly fewer nodes than the next if that has no more than so many times as many.
THIN = 1.5
#: Node pairs that are expanded together, and those whose vectors are held side by side.
ABREAST = 1 << 18
#: A matrix product takes so many pairs while one pair is taken by itself.
DENSE = 16
BESIDE = 1 << 13


class CoverTree:
    """Levels of nodes over unit vectors. Nodes of a level lie in the order of their parents, so a
    node's children are a range of the next level, and its members a range of ``order``."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        owner = np.zeros(n, np.int64)  # each vector's node at the level above
        centres = np.zeros(1, np.int64)
        radius = 2.0
        levels = []
        while True:
            levels.append((centres, owner))
            if len(centres) == n:
                break
            radius /= 2
            if radius < 1e-9:  # what is left differs by rounding alone
                centres, owner = np.argsort(owner, kind="stable"), np.empty(n, np.int64)
                owner[centres] = np.arange(n)
                levels.append((centres, owner))
                break
            centres, owner = _cover(unit, centres, owner, radius)
        self.order = np.argsort(owner, kind="stable")
        # a node's members are contiguous because children are numbered in their parents' order
        self.centre = [c for c, _ in levels]
        self.first, self.radius, self.child = [], [], []
        for k, (c, own) in enumerate(levels):
            size = np.bincount(own, minlength=len(c))
            self.first.append(np.concatenate([[0], np.cumsum(size)]))
            gap = np.linalg.norm(unit - unit[c[own]], axis=1)
            far = np.zeros(len(c))
            np.maximum.at(far, own, gap)
            self.radius.append(far)
            if k + 1 < len(levels):
                below = own[levels[k + 1][0]]
                self.child.append(np.searchsorted(below, np.arange(len(c) + 1)))

    def thinned(self, limit: float) -> CoverTree:
        """The tree without the levels that hardly have fewer nodes than the next, with balls too wide
        to be told apart by the limit: the next level's bounds cost no more and hold."""
        tree = copy.copy(self)
        tree.centre, tree.first, tree.radius, tree.child = [], [], [], []
        for k in range(len(self.centre)):
            below = len(self.centre[k + 1]) if k + 1 < len(self.centre) else np.inf
            if k and self.radius[k].max() > limit / 2 and below <= THIN * len(self.centre[k]):
                tree.child[-1] = self.child[k][tree.child[-1]]
                continue
            for have, of in ((tree.centre, self.centre), (tree.first, self.first), (tree.radius, self.radius), (tree.child, self.child)):
                have += of[k:k + 1]
        return tree


def _cover(unit: np.ndarray, above: np.ndarray, owner: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Within each node, centres more than radius apart that reach every member, the node's own
    centre among them; and each vector's nearest of its node's centres."""
    rows = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[rows], np.arange(len(above) + 1))
    centres: list[int] = []
    mine = np.empty(len(unit), np.int64)
    for node, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        members = rows[a:b]
        base = len(centres)
        if b - a == 1:
            centres.append(int(members[0]))
            mine[members] = base
            continue
        chosen = [int(above[node])]
        best = _distance(unit[members], unit[chosen[0]][None])[:, 0]
        nearest = np.zeros(b - a, np.int64)
        # candidates in batches: distances inside a batch decide which of them become centres
        while True:
            left = np.flatnonzero(best > radius)
            if not len(left):
                break
            batch = left[:256]
            between = _distance(unit[members[batch]], unit[members[batch]])
            free = np.ones(len(batch), bool)
            picked = []
            for i in range(len(batch)):
                if free[i]:
                    picked.append(i)
                    free &= between[i] > radius
            start = len(chosen)
            chosen += members[batch[picked]].tolist()
            gap = _distance(unit[members], unit[chosen[start:]])
            near = gap.argmin(1)
            value = gap[np.arange(len(gap)), near]
            closer = value < best
            best[closer], nearest[closer] = value[closer], near[closer] + start
        centres += chosen
        mine[members] = base + nearest
    return np.array(centres), mine


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _paired(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of x[i] and y[j], pair by pair; of all pairs, few vectors are copied at once."""
    out = np.empty(len(i))
    for at in range(0, len(i), BESIDE):
        s = slice(at, at + BESIDE)
        np.einsum("ij,ij->i", x[i[s]], y[j[s]], out=out[s])
    return out


def dual_traversal(x: np.ndarray, tx: CoverTree, y: np.ndarray, ty: CoverTree, cosine: float, same: bool):
    """Yields (i, j) arrays of linked vectors, and (member range of x, member range of y) of nodes
    that link wholly. x and y are unit vectors; with ``same`` both are one tree, and pairs come in
    either or both orders and include vectors paired with themselves."""
    limit = np.sqrt(max(0.0, 2 - 2 * cosine))
    depth = max(len(tx.centre), len(ty.centre))
    at = lambda tree, k: min(k, len(tree.centre) - 1)
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), False)]
    while stack:
        level, a, b, kept = stack.pop()
        la, lb = at(tx, level), at(ty, level)
        if not kept:
            dots = _paired(x, tx.centre[la][a], y, ty.centre[lb][b])
            gap = np.sqrt(np.maximum(2 - 2 * dots, 0))
            reach = tx.radius[la][a] + ty.radius[lb][b]
            keep = gap <= limit + reach + SLACK
            whole = keep & (gap + reach < limit - SLACK) & (reach > 0)
            if whole.any():
                yield "nodes", (la, a[whole]), (lb, b[whole])
            keep &= ~whole
            a, b = a[keep], b[keep]
            if level == depth - 1:
                exact = dots[keep] >= cosine
                yield "vectors", tx.centre[la][a[exact]], ty.centre[lb][b[exact]]
                continue
            if la == at(tx, level + 1) and lb == at(ty, level + 1):
                stack.append((depth - 1, a, b, False))
                continue
        if len(a):
            _split(stack, level, a, b, tx, ty, x, y, la, lb, limit, at)


def _split(stack, level, a, b, tx, ty, x, y, la, lb, limit, at):
    """Pairs of children of the first of pairs (a, b), some ABREAST, or of all with matrix products if a pair has many
    or the pairs are much of what their nodes could be paired to; the other pairs wait as they are, so the stack holds
    no more than that for a level."""
    def children(tree, k, nodes):
        if k == at(tree, level + 1):
            return nodes, np.ones(len(nodes), np.int64)
        return tree.child[k][nodes], tree.child[k][nodes + 1] - tree.child[k][nodes]

    def below(tree, k, nodes):
        """The children of nodes, and the place in nodes of the parent of each."""
        first, n = children(tree, k, nodes)
        return np.repeat(first, n) + w.ranges(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)

    last = at(tx, level + 2) == at(tx, level + 1) and at(ty, level + 2) == at(ty, level + 1)
    ra, rb = tx.radius[at(tx, level + 1)], ty.radius[at(ty, level + 1)]
    # two balls are near enough if their centres' cosine is at least that of limit + radii
    near = lambda r: 1 - np.minimum(limit + 2 * SLACK + r, 2.0) ** 2 / 2
    # single precision is enough to drop pairs: its rounding is allowed for, and what is left is taken exactly
    rough = (x.shape[1] + 8) * float(np.finfo(np.float32).eps)

    def product(ca, cb, paired):
        wide = _by_radius(ra, ca)
        for kb in _by_radius(rb, cb):
            right = y[ty.centre[at(ty, level + 1)][cb[kb]]].astype(np.float32)
            step = max(1, ABREAST // len(kb))
            for ka in (k[s:s + step] for k in wide for s in range(0, len(k), step)):
                dots = (x[tx.centre[at(tx, level + 1)][ca[ka]]].astype(np.float32) @ right.T).ravel()
                # one bound for all, then for those left their own
                found = np.flatnonzero(dots >= np.float32(near(ra[ca[ka]].max() + rb[cb[kb]].max()) - rough))
                p, q = ka[found // len(kb)], kb[found % len(kb)]
                dots, reach = dots[found], ra[ca[p]] + rb[cb[q]]
                own = paired(p, q) & (dots >= near(reach) - rough)
                # exact cosines are for vectors, and for balls that may lie within the limit
                exact = last | ((reach < limit) & (dots >= 1 - (limit - reach) ** 2 / 2 - rough))
                for some, kept in ((own & ~exact, True), (own & exact, False)):
                    if some.any():
                        stack.append((level + 1, ca[p[some]], cb[q[some]], kept))

    fa, na = children(tx, la, a)
    fb, nb = children(ty, lb, b)
    many = na * nb
    if len(a) > 1 and many.sum() > 4096:
        (ua, ia), (ub, ib) = _distinct(a), _distinct(b)
        ca, above_a = below(tx, la, ua)
        cb, above_b = below(ty, lb, ub)
        if len(ca) * len(cb) <= DENSE * many.sum():
            have = np.zeros((len(ua), len(ub)), bool)
            have[ia, ib] = True
            product(ca, cb, lambda p, q: have[above_a[p], above_b[q]])
            return
    stop = max(1, int(np.searchsorted(np.cumsum(many), ABREAST, "right")))
    if stop < len(a):
        stack.append((level, a[stop:], b[stop:], True))
        a, b, fa, na, fb, nb, many = (v[:stop] for v in (a, b, fa, na, fb, nb, many))
    big = many > 4096
    for i in np.flatnonzero(big).tolist():
        product(np.arange(fa[i], fa[i] + na[i]), np.arange(fb[i], fb[i] + nb[i]), lambda p, q: np.ones(len(p), bool))
    fa, na, fb, nb, many = (v[~big] for v in (fa, na, fb, nb, many))
    if len(many):
        pair = np.repeat(np.arange(len(many)), many)
        inner = w.ranges(np.zeros(len(many), np.int64), many)
        stack.append((level + 1, fa[pair] + inner // nb[pair], fb[pair] + inner % nb[pair], False))


def _distinct(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, each once, and the place of each of them there."""
    have = np.zeros(nodes.max() + 1, bool)
    have[nodes] = True
    return np.flatnonzero(have), (np.cumsum(have) - 1)[nodes]


def _by_radius(radius: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """Places of nodes in runs whose radii are all 0, or within a factor of two."""
    order = np.argsort(radius[nodes], kind="stable")
    kind = np.ceil(np.log2(np.maximum(radius[nodes[order]], 1e-10)))
    return np.split(order, np.flatnonzero(np.diff(kind)) + 1)


class Forest:
    """Union-find that keeps only links between what was not yet joined."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def grow(self, n: int) -> int:
        """Room for n more; where it begins."""
        have = len(self.up)
        self.up = np.concatenate([self.up, np.arange(have, have + n)])
        return have

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return values / np.linalg.norm(values, axis=1, keepdims=True)


_PLANTED = "width int, block long, data binary, centre array<double>, radius double, gap double"
_FOUND = "cls binary, links bigint, other binary"


def _plant(key: tuple, table: pa.Table) -> pa.Table:
    """A block's classes, their rows and vectors, and its tree, packed for all pairs that it is in."""
    table = table.take(pc.sort_indices(table, sort_keys=[("cls", "ascending")]))
    names, vector = (pa.concat_arrays(table.column(c).chunks) for c in ("cls", "vector"))
    first = np.flatnonzero(np.concatenate([[True], pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)]))
    names, n = names.take(pa.array(first)), np.add.reduceat(table.column("n").to_numpy(), first)
    values = vector.flatten().to_numpy().reshape(len(vector), -1)[first]
    unit = _unit(values.astype(float))
    tree = CoverTree(unit)
    with np.errstate(over="ignore"):
        short = values.astype(np.float32)
    exact = bool((short == values).all())  # then vectors are held in half the bytes
    data = pickle.dumps((names, n, short if exact else values, tree))
    centre, radius = unit[tree.centre[0][0]], float(tree.radius[0][0])
    width, grp, block = (k.as_py() for k in key)
    return pa.table({"width": pa.array([width], pa.int32()), "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "gap": pa.array([pc.max(table.column("gap")).as_py()], pa.float64()), "grp": pa.array([grp], pa.int64())})


def _nearest(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and its cosine. Of pivots that rounding could exchange, a sum in fixed order
    decides, so that a vector has one wherever it is met."""
    dots = unit @ pivots.T
    best = dots.argmax(1)
    top = dots[np.arange(len(dots)), best]
    near = dots >= top[:, None] - 1e-9
    some = np.flatnonzero(near.sum(1) > 1)
    i, j = np.nonzero(near[some])
    exact = np.cumsum(unit[some[i]] * pivots[j], axis=1)[:, -1]
    order = np.lexsort((j, -exact, i))
    best[some] = j[order[np.searchsorted(i, np.arange(len(some)))]]
    return best, top


def _cells(pivots: dict[int, np.ndarray], by: str, keep: list[str]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest pivot of each vector, and how far it is, beside the columns to keep. Of rows of a batch that
        are the same by a column, one is left, with the sum of their n."""
        for batch in batches:
            same = pc.dictionary_encode(batch.column(by))
            if len(same.dictionary) < batch.num_rows:
                which = same.indices.to_numpy()
                columns = dict(zip(batch.schema.names, batch.take(pa.array(np.unique(which, return_index=True)[1])).columns, strict=True))
                if "n" in columns:
                    n = np.zeros(len(same.dictionary), np.int64)
                    np.add.at(n, which, batch.column("n").to_numpy())
                    columns["n"] = pa.array(n)
                batch = pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
            width, vector = (batch.column(batch.schema.get_field_index(c)) for c in ("width", "vector"))
            width = width.to_numpy()
            cell, gap = np.zeros(len(width), np.int64), np.zeros(len(width))
            for k in np.unique(width).tolist():
                every = np.flatnonzero(width == k)
                for at in (every[i:i + 2048] for i in range(0, len(every), 2048)):
                    cell[at], top = _nearest(_unit(np.asarray(vector.take(pa.array(at)).flatten()).reshape(-1, k).astype(float)), pivots[k])
                    gap[at] = np.sqrt(np.maximum(2 - 2 * top, 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(cell), pa.array(gap)], names=[*keep, "cell", "gap"])

    return deal


def _spread(unit: np.ndarray, k: int) -> np.ndarray:
    """k of some vectors, each the farthest from those before, so that no cluster is without one."""
    chosen, far = [0], _distance(unit, unit[:1])[:, 0]
    while len(chosen) < min(k, len(unit)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(unit, unit[chosen[-1:]])[:, 0])
    return unit[chosen]


def _near_cells(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray], limit: float) -> list[tuple[int, int, int]]:
    """width, cell, cell of those whose balls come within the limit; a cell without vectors has radius -1."""
    out = []
    for k, p in pivots.items():
        near = _distance(p, p) <= limit + radius[k][:, None] + radius[k][None] + SLACK
        near &= (radius[k] >= 0)[:, None] & (radius[k] >= 0)[None]
        i, j = np.nonzero(np.triu(near))
        out += [(k, a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    return out


def block_pairs(planted: DataFrame, near: list[tuple[int, int, int]], limit: float) -> DataFrame:
    """width, lo, hi of the blocks in near cells whose own balls come within the limit, and their groups, the lower first."""
    meta = planted.select("width", "block", (F.col("block") % PIVOTS).alias("cell"), "centre", "radius", "grp")
    x, y = (F.broadcast(meta.select("width", *(F.col(c).alias(f"{s}_{c}") for c in ("block", "cell", "centre", "radius", "grp")))) for s in ("a", "b"))
    cells = planted.sparkSession.createDataFrame(near, "width int, a_cell long, b_cell long")
    dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    gap = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    close = (gap <= limit + F.col("a_radius") + F.col("b_radius") + SLACK) & ((F.col("a_cell") < F.col("b_cell")) | (F.col("a_block") <= F.col("b_block")))
    pairs = cells.join(x, ["width", "a_cell"]).join(y, ["width", "b_cell"]).where(close)
    ordered = (f(f"a_{c}", f"b_{c}").alias(name) for c, f, name in (("block", F.least, "lo"), ("block", F.greatest, "hi"), ("grp", F.least, "one"), ("grp", F.greatest, "other")))
    return pairs.select("width", *ordered)


def planted_blocks(classes: DataFrame, block: int, limit: float) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The trees of classes(cls, n, vector, width), and the pairs of cells that the limit leaves. A class may be of
    several rows, whose n are added: in cells with few such rows by the task of its block, else before it is dealt."""
    spark, tasks = classes.sparkSession, parts(classes.sparkSession)
    keyed = classes.select("width", "vector", F.xxhash64("vector").alias("key"))
    numbers = (F.count("*").alias("rows"), F.approx_count_distinct("key").alias("many"))
    counted = {r.width: _classes(r) for r in keyed.groupBy("width").agg(*numbers).collect()}
    pivots = {k: min(-(-n // block), PIVOTS) for k, n in counted.items()}
    # twice as many as are drawn pass a bound on their hash, so that no more are sorted
    share = [(k, p, min(1 << 30, (2 * DRAWN * p << 30) // counted[k] + 1)) for k, p in pivots.items()]
    widths = F.broadcast(spark.createDataFrame(share, "width int, pivots long, share long"))
    drawn = keyed.join(widths, "width").where(F.pmod("key", F.lit(1 << 30)) < F.col("share")).groupBy("width", "pivots", "key").agg(F.any_value("vector").alias("vector"))
    draw = Window.partitionBy("width").orderBy("key")
    drawn = drawn.withColumn("place", F.row_number().over(draw)).where(F.col("place") <= DRAWN * PIVOTS).where(f"place <= {DRAWN} * pivots")
    found: dict[int, list] = {}
    for r in drawn.select("width", "place", "vector").orderBy("width", "place").collect():
        found.setdefault(r.width, []).append(r.vector)
    units = {k: _spread(_unit(np.array(v, float)), pivots[k]) for k, v in found.items()}
    cells = keyed.mapInArrow(_cells(units, "key", ["width", "key"]), "width int, key long, cell long, gap double")
    held = {(r.width, r.cell): r for r in cells.groupBy("width", "cell").agg(*numbers).collect()}
    size = 4 if dict(classes.dtypes)["vector"] == "array<float>" else 8
    table, start = [], 0
    for k, u in units.items():
        for cell in range(len(u)):
            r = held.get((k, cell))
            many = _classes(r) if r else 0
            pieces = max(1, -(-many // block))
            each = -(-many // pieces) * (k * size + BESIDES)
            table.append((k, cell, pieces, start, each, bool(r) and many < r.rows))
            start += pieces * each
    # groups are files of bounded size, and enough for their pairs to fill the tasks
    group = max(1, min(GROUP, -(-start // math.isqrt(2 * tasks))))
    places = F.broadcast(spark.createDataFrame(table, "width int, cell long, parts long, start long, each long, again boolean"))
    fields = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    dealt = classes.mapInArrow(_cells(units, "cls", classes.columns), f"{fields}, cell long, gap double").join(places, ["width", "cell"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    grp = F.floor((F.col("start") + F.col("part") * F.col("each")) / group)
    dealt = dealt.select("width", grp.alias("grp"), (F.col("cell") + PIVOTS * F.col("part")).alias("block"), "cls", "n", "vector", "gap", "again")
    once, again = dealt.where("not again").drop("again"), dealt.where("again")
    again = again.groupBy("width", "grp", "block", "cls").agg(F.sum("n").alias("n"), F.any_value("vector").alias("vector"), F.max("gap").alias("gap"))
    several = {t[-1] for t in table if (t[0], t[1]) in held}
    dealt = once.union(again) if len(several) > 1 else again if True in several else once
    # every tree is built once, however many pairs its block is in
    planted = dealt.repartition(tasks, "grp").groupBy("width", "grp", "block").applyInArrow(_plant, f"{_PLANTED}, grp long")
    path = f"{checkpoint_root(spark)}/cover-trees-{uuid.uuid4().hex}"
    planted.write.partitionBy("grp").option("compression", "zstd").parquet(path)
    planted = spark.read.schema(f"{_PLANTED}, grp long").parquet(path)
    radius = {k: np.full(len(u), -1.0) for k, u in units.items()}
    for r in planted.groupBy("width", (F.col("block") % PIVOTS).alias("cell")).agg(F.max("gap").alias("radius")).collect():
        radius[r.width][r.cell] = r.radius
    return planted, _near_cells(units, radius, limit)


def _classes(counted: Row) -> int:
    """How many classes are taken for so many rows and about so many of them: all rows, if few are more than that."""
    return counted.rows if counted.rows <= AGAIN * counted.many else counted.many


class _Block:
    """A planted block that a task has read; unpacked when a pair of it is searched."""

    def __init__(self, row: dict, limit: float, forest: Forest):
        self.width, self.centre, self.radius = row["width"], np.array(row["centre"]), row["radius"]
        self.packed, self.limit, self.forest = row["data"], limit, forest

    def near(self, other: _Block) -> bool:
        if self.width != other.width:
            return False
        gap = float(np.sqrt(max(0.0, 2 - 2 * float(self.centre @ other.centre))))
        return gap <= self.limit + self.radius + other.radius + SLACK

    def unpacked(self) -> _Block:
        if self.packed is not None:
            self.names, n, values, tree = pickle.loads(self.packed)
            self.packed, self.n, self.unit, self.tree = None, n, _unit(values.astype(float)), tree.thinned(self.limit)
            self.links, self.base = np.zeros(len(n), np.int64), self.forest.grow(len(n))
        return self

    def found(self) -> Iterator[pa.RecordBatch]:
        """The links of its classes."""
        some = np.flatnonzero(self.links) if self.packed is None else []
        if len(some):
            yield _rows(self.names.take(pa.array(some)), pa.array(self.links[some]), pa.nulls(len(some), pa.binary()))


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([*columns], names=["cls", "links", "other"])


def _link(x: _Block, y: _Block, cosine: float) -> Iterator[pa.RecordBatch]:
    """Counts the links of two blocks of vectors of one length (or of one with itself), and gives the edges of them
    that join what the task had not yet joined."""
    if not x.near(y):
        return
    same = x is y
    tx, ty = x.unpacked().tree, y.unpacked().tree
    forest = x.forest
    for kind, p, q in dual_traversal(x.unit, tx, y.unit, ty, cosine, same):
        if kind == "vectors":
            np.add.at(x.links, p, y.n[q])
            if not same:
                np.add.at(y.links, q, x.n[p])
            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                forest.join(x.base + i, y.base + j)
            continue
        sums_x = np.concatenate([[0], np.cumsum(x.n[tx.order])])
        sums_y = np.concatenate([[0], np.cumsum(y.n[ty.order])])
        for a, b in zip(p[1].tolist(), q[1].tolist(), strict=True):
            a0, a1 = tx.first[p[0]][a:a + 2]
            b0, b1 = ty.first[q[0]][b:b + 2]
            ia, ib = tx.order[a0:a1], ty.order[b0:b1]
            x.links[ia] += sums_y[b1] - sums_y[b0]
            if not same:
                y.links[ib] += sums_x[a1] - sums_x[a0]
            for i in ia.tolist():
                forest.join(x.base + i, y.base + int(ib[0]))
            for j in ib.tolist():
                forest.join(x.base + int(ia[0]), y.base + j)
    if same:
        x.links -= x.n  # each class was paired with itself once
    if forest.edges:
        i, j = np.array(forest.edges, np.int64).T
        forest.edges.clear()
        yield _rows(x.names.take(pa.array(i - x.base)), pa.array(np.zeros(len(i), np.int64)), y.names.take(pa.array(j - y.base)))


def _search(cosine: float, blocks: dict[int, int]):
    limit = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of one group, then those of the groups that it meets: links of each class with rows of the
        pairs of them, and the edges of a spanning forest. Of the others one block is held at a time."""
        forest, own, early, task = Forest(0), [], [], None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["task"] != task:
                    for x in own:
                        yield from x.found()
                    forest, own, early, task = Forest(0), [], [], row["task"]
                y = _Block(row, limit, forest)
                if row["grp"] != row["one"]:
                    if len(own) < blocks[row["one"]]:  # it came before the last of the group
                        early.append(y)
                        continue
                    for x in own:
                        yield from _link(x, y, cosine)
                    yield from y.found()
                    continue
                own.append(y)
                for x in own if row["itself"] else ():
                    yield from _link(x, y, cosine)
                if len(own) == blocks[row["one"]]:
                    for z in early:
                        for x in own:
                            yield from _link(x, z, cosine)
                        yield from z.found()
                    early = []
        for x in own:
            yield from x.found()

    return search


def linked(planted: DataFrame, near: list[tuple[int, int, int]], cosine: float) -> DataFrame:
    """cls, links: of classes of planted blocks with rows of other classes; cls, other: edges of spanning forests.
    Tasks read the groups that they search from where they are planted, so no pair of blocks is ever copied."""
    spark, limit = planted.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    blocks = {r["grp"]: r["count"] for r in planted.groupBy("grp").count().collect()}
    pairs = block_pairs(planted, near, limit).select("one", "other").distinct().orderBy("one", "other").collect()
    meets: dict[int, list[int]] = {}
    for r in pairs:
        meets.setdefault(r.one, []).append(r.other)
    step = max(1, min(MET, len(pairs) // parts(spark)))
    todo = [(one, others[i:i + step]) for one, others in meets.items() for i in range(0, len(others), step)]
    of = lambda groups: planted.where(F.col("grp").isin(groups)).select("grp", "width", "centre", "radius", "data")
    found = []
    for at in range(0, len(todo), JOB):
        # a union of single partitions alone would be a single partition; one without any keeps them apart
        tasks = [of([-1]).select("*", *(F.lit(x).alias(c) for c, x in (("one", -1), ("task", -1), ("itself", False))))]
        for k, (one, others) in enumerate(todo[at:at + JOB]):
            read = reduce(DataFrame.union, [of(g) for g in ([one], [o for o in others if o != one]) if g]).coalesce(1)
            tasks.append(read.select("*", *(F.lit(x).alias(c) for c, x in (("one", one), ("task", k), ("itself", one in others)))))
        while len(tasks) > 1:
            tasks = [reduce(DataFrame.union, tasks[i:i + 8]) for i in range(0, len(tasks), 8)]
        found.append(written(tasks[0].mapInArrow(_search(cosine, blocks), _FOUND), "cover-links"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], _FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))
    kind = "float" if vectors.select("embedding").dtypes[0][1] == "array<float>" else "double"
    # -0.0 and 0.0 are one number
    plain = F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    # 128 bits of SHA-256 name a class
    name = lambda vector: F.substring(F.unhex(F.sha2(F.to_json(F.struct(vector.alias("vector"))).cast("binary"), 256)), 1, 16)
    rows = written(vectors.select("vec_id", F.when(usable, name(plain)).alias("cls")), "vector-names")
    classes = vectors.where(usable).select(plain.alias("vector")).select(name(F.col("vector")).alias("cls"), F.lit(1).cast("long").alias("n"), "vector", F.size("vector").alias("width"))
    limit = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    planted, near = planted_blocks(classes, block, limit)
    found = linked(planted, near, cosine)
    links = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    classes = written(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "vector-classes")
    # most classes may link with none: only those that do are joined for their components
    rooted = joined.withColumnRenamed("node", "cls").join(classes.select("cls", "least"), "cls")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.select("cls", "root").join(least, "root").select("cls", "component_id")
    known = classes.join(rooted, "cls", "left").join(links, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(known, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


#: The same in DuckDB SQL.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT c.vec_id, p.b FROM c JOIN p ON p.a = c.reached),
m AS (SELECT vec_id, min(reached) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT m.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept
FROM m LEFT JOIN n ON n.vec_id = m.vec_id
"""
