"""Hard negatives by exact inner-product search in cover trees over norm-augmented candidates.

Components are made integers, so scores are exact. A candidate gets one more component which brings
its norm to the greatest norm of all, M; an anchor gets a zero there, so inner products stay, and
all candidates lie on a sphere of radius M. With the angle t between an anchor and a node's centre and
the node's covering radius r, also an angle, every inner product in the node lies between
``|q| M cos(t + r)`` and ``|q| M cos(t - r)``.

1. Candidates with one vector and one label are one leaf. No more than PER_CLASS of its rows can be
   among any anchor's first, so the others, larger ids with the same scores, stay behind (exact: the
   first rows are chosen by score, then id).
2. Leaves are dealt to cells by the nearest of a bounded number of pivots, and a cell's leaves are a
   cover tree, or several if they are many: nested levels with halving angles, each node with the
   true angle to its farthest leaf. A cell's radius bounds all that is in it.
3. A request is an anchor with a window of scores and the least score that can still matter. It goes
   first to its own cell, then, with the least score found there, to the cells that its bounds leave.
   In a tree it goes down best first: nodes whose bounds miss the window or the least score are
   skipped, the others split, and leaves are scored exactly.
4. An anchor's positives are one request for rows of its label; its windows of negatives are requests
   for rows of others.

Requests travel in chunks, trees in bounded blocks, so no task holds more than one of each, and
nothing but the pivots, the cells' radii and a few sizes reaches the driver. In general position no bound can
prune, and each anchor then meets every leaf, in blocks.

Null labels, null or empty vectors and those with null or non-finite components take no part. Vectors of
different lengths never meet. A null vec_id is no anchor and comes last among ties. Rows are rows: a
row that repeats is another candidate and another anchor, which the results repeat. Vectors so
large that scores could leave 62 bits raise an error. Extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import parts, saved

FIRST = 5
#: Of rows with one vector and label, an anchor among them, its FIRST others are these at most.
PER_CLASS = FIRST + 1
#: Negatives score at least so many hundredths of the positive, and at most all.
LEAST_PERCENT = 80
ANCHORS = 100
#: Leaves in one tree, requests in one chunk, and pivots: what a task holds and what is broadcast.
BLOCK = 4096
CHUNK = 512
PIVOTS = 1024
#: What rounding can add to a bound, as a share of |q| M.
SLACK = 1e-6
#: Less than any score.
NONE = -(1 << 63)
#: Node and request pairs looked at together.
ABREAST = 1 << 20


def _unit(values: np.ndarray, greatest: float) -> np.ndarray:
    """Augmented to norm `greatest`, then scaled to 1."""
    if not greatest:
        return np.concatenate([values, np.ones((len(values), 1))], axis=1)
    values = values / greatest
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", values, values), 0))
    return np.concatenate([values, rest[:, None]], axis=1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class Tree:
    """Cover tree over unit vectors with angles as distances. Each level has its nodes' centres (leaf
    numbers), covering radii and numbers of leaves, and the ranges of their children on the next;
    the last level holds every leaf."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.centre, self.radius, self.count, self.child = [], [], [], []
        centre, owner, reach = np.zeros(1, np.int64), np.zeros(n, np.int64), np.pi
        while True:
            far = np.zeros(len(centre))
            np.maximum.at(far, owner, _angle(np.einsum("ij,ij->i", unit, unit[centre[owner]])))
            self.centre.append(centre)
            self.radius.append(far)
            self.count.append(np.bincount(owner, minlength=len(centre)))
            if len(centre) == n:
                break
            reach /= 2
            # what lies closer than rounding can tell is not divided further
            below, mine = self._divide(unit, centre, owner, reach if reach > 1e-6 else -1.0)
            self.child.append(np.searchsorted(owner[below], np.arange(len(centre) + 1)))
            centre, owner = below, mine

    @staticmethod
    def _divide(unit: np.ndarray, centre: np.ndarray, owner: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Each node's leaves, divided among centres of their own more than reach apart."""
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(centre) + 1))
        below, mine = [], np.empty(len(unit), np.int64)
        for k in range(len(centre)):
            mine_here = order[cut[k]:cut[k + 1]]
            base = len(below)
            if reach < 0 or len(mine_here) == 1:
                below += mine_here.tolist()
                mine[mine_here] = base + np.arange(len(mine_here))
                continue
            chosen, near = [int(centre[k])], np.zeros(len(mine_here), np.int64)
            best = unit[mine_here] @ unit[chosen[0]]
            floor = np.cos(reach)
            while True:
                left = np.flatnonzero(best < floor)[:128]
                if not len(left):
                    break
                among = unit[mine_here[left]] @ unit[mine_here[left]].T
                free, picked = np.ones(len(left), bool), []
                for i in range(len(left)):
                    if free[i]:
                        picked.append(i)
                        free &= among[i] < floor
                new = mine_here[left[picked]]
                dots = unit[mine_here] @ unit[new].T
                to = dots.argmax(1)
                value = dots[np.arange(len(dots)), to]
                closer = value > best
                best[closer], near[closer] = value[closer], to[closer] + len(chosen)
                chosen += new.tolist()
            below += chosen
            mine[mine_here] = base + near
        return np.array(below), mine


class Best:
    """The best leaves of each request, and the floor below which a score no longer matters: that of
    the leaf which brings its rows to PER_CLASS (one of them may be the anchor itself)."""

    def __init__(self, floor: np.ndarray):
        self.floor = floor
        self.request, self.leaf, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, floor.dtype)

    def add(self, request: np.ndarray, leaf: np.ndarray, score: np.ndarray, copies: np.ndarray) -> None:
        r, f, s = np.concatenate([self.request, request]), np.concatenate([self.leaf, leaf]), np.concatenate([self.score, score])
        order = np.lexsort([-s, r])
        r, f, s = r[order], f[order], s[order]
        until = np.cumsum(copies[f])
        before = until - copies[f]
        before -= before[np.searchsorted(r, r)]
        full = (before < PER_CLASS) & (before + copies[f] >= PER_CLASS)
        np.maximum.at(self.floor, r[full], s[full])
        keep = s >= self.floor[r]
        self.request, self.leaf, self.score = r[keep], f[keep], s[keep]


@dataclass
class Leaves:
    """A block's leaves: integer vectors, labels, ids of their rows, and their tree."""

    vector: np.ndarray
    label: np.ndarray
    ids: list[list]
    tree: Tree


@dataclass
class Requests:
    """Anchors' vectors and labels; scores wanted from least to most, and at least floor; and whether
    from rows of the same label or of others."""

    vector: np.ndarray
    label: np.ndarray
    least: np.ndarray
    most: np.ndarray
    floor: np.ndarray
    same: bool


def _bounds(query: np.ndarray, greatest: float, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product that each query can have in each ball."""
    size = np.sqrt(np.einsum("ij,ij->i", query, query))[:, None]
    # an anchor's own added component is zero
    angle = _angle((query / np.maximum(size, 1e-300)) @ centres[:, :-1].T)
    scale, slack = size * greatest, SLACK * size * greatest + 1e-6
    return scale * np.cos(np.minimum(angle + radius, np.pi)) - slack, scale * np.cos(np.maximum(angle - radius, 0)) + slack


def descend(leaves: Leaves, asked: Requests, greatest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, leaf, score) of the leaves that can hold a request's first rows."""
    tree = leaves.tree
    query, exact = _integers(asked.vector, leaves.vector)
    least, most, floor = (x.astype(query.dtype) for x in (asked.least, asked.most, asked.floor))
    best = Best(np.maximum(least, floor))
    unit, plain = _unit(leaves.vector, greatest), asked.vector
    copies = np.array([len(x) for x in leaves.ids], np.int64)
    last = len(tree.centre) - 1

    def score(who: np.ndarray, some: np.ndarray) -> None:
        """Scores leaves exactly."""
        step = max(1, ABREAST // len(some))
        for r in (who[i:i + step] for i in range(0, len(who), step)):
            scores = query[r] @ exact[some].T
            fits = (leaves.label[some][None] == asked.label[r][:, None]) == asked.same
            fits &= (scores >= least[r][:, None]) & (scores <= most[r][:, None])
            scores = np.where(fits, scores, NONE)
            if len(some) > PER_CLASS:
                best.floor[r] = np.maximum(best.floor[r], np.partition(scores, -PER_CLASS, axis=1)[:, -PER_CLASS])
            i, j = np.nonzero(fits & (scores >= best.floor[r][:, None]))
            found.append((r[i], some[j], scores[i, j]))

    n = len(plain)
    frontier = (np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf))
    at_once = 4
    while len(frontier[0]):
        # each request's best nodes are its turn; the others wait, and may fall below its floor
        keep = frontier[3] >= best.floor[frontier[0]]
        frontier = tuple(x[keep] for x in frontier)
        if not len(frontier[0]):
            break
        order = np.lexsort([-frontier[3], frontier[0]])
        frontier = tuple(x[order] for x in frontier)
        turn = np.arange(len(order)) - np.searchsorted(frontier[0], frontier[0]) < at_once
        rest = [tuple(x[~turn] for x in frontier)]
        request, level, node = (x[turn] for x in frontier[:3])
        group = np.lexsort([request, node, level])
        request, level, node = request[group], level[group], node[group]
        cut = np.flatnonzero((np.diff(level, prepend=-1) != 0) | (np.diff(node, prepend=-1) != 0))
        found: list = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(node)], strict=True):
            k, who = int(level[a]), request[a:b]
            if k == last:
                score(who, tree.centre[k][node[a]:node[a] + 1])
                continue
            kids = np.arange(tree.child[k][node[a]], tree.child[k][node[a] + 1])
            single = tree.count[k + 1][kids] == 1
            if single.any():
                score(who, tree.centre[k + 1][kids[single]])
            kids = kids[~single]
            if not len(kids):
                continue
            step = max(1, ABREAST // len(kids))
            for r in (who[i:i + step] for i in range(0, len(who), step)):
                low, high = _bounds(plain[r], greatest, unit[tree.centre[k + 1][kids]], tree.radius[k + 1][kids])
                i, j = np.nonzero((high >= best.floor[r][:, None]) & (low <= most[r][:, None]))
                rest.append((r[i], np.full(len(i), k + 1), kids[j], high[i, j]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)), copies)
        frontier = tuple(np.concatenate(x) for x in zip(*rest, strict=True))
        at_once *= 2
    return best.request, best.leaf, best.score


def _integers(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if top < 2.0 ** 53:
        return x, y
    if top < 2.0 ** 62:
        return x.astype(np.int64), y.astype(np.int64)
    raise ValueError("inner products of these vectors do not fit 64 bits")


def _small(values: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    top = float(np.abs(values).max(initial=0))
    return values.astype(np.int16) if top < 2 ** 15 else values.astype(np.int32) if top < 2 ** 31 else values


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks]).reshape(-1, width)


def _plant(greatest: float):
    def plant(key: tuple, table: pa.Table) -> pa.Table:
        """A block's leaves and their tree, packed once for all chunks."""
        table = table.sort_by("cls")
        values = _matrix(table.column("vector"), key[0].as_py())
        data = pickle.dumps((_small(values), table.column("label").to_numpy(), table.column("ids").to_pylist(), Tree(_unit(values, greatest))))
        return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    return plant


def _pack_requests(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("rid")
    columns = {c: table.column(c).to_numpy() for c in ("label", "own", "least", "most", "floor")}
    data = pickle.dumps((table.column("rid").to_pylist(), _small(_matrix(table.column("vector"), key[0].as_py())), columns))
    return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})


_FOUND = "rid string, vec_id bigint, score bigint"


def _search(greatest: float, same: bool):
    def search(key: tuple, table: pa.Table) -> pa.Table:
        """One chunk of requests in one block's tree."""
        vector, label, ids, tree = pickle.loads(table.column("data")[0].as_py())
        rid, query, c = pickle.loads(table.column("requests")[0].as_py())
        asked = Requests(query.astype(float), c["label"], c["least"], c["most"], c["floor"], same)
        r, f, s = descend(Leaves(vector.astype(float), label, ids, tree), asked, greatest)
        size = np.array([len(x) for x in ids], np.int64)[f]
        return pa.table({"rid": pa.array([rid[i] for i in np.repeat(r, size).tolist()], pa.string()), "vec_id": pa.array([i for leaf in f.tolist() for i in ids[leaf]], pa.int64()), "score": pa.array(np.repeat(s, size).astype(np.int64))})

    return search


def _cells(pivots: dict[int, np.ndarray], greatest: float):
    """The cell of each row's vector, and its angle to the pivot."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(batch.schema.get_field_index("width")).to_numpy()
            vector = batch.column(batch.schema.get_field_index("vector"))
            cell, angle = np.zeros(len(width), np.int32), np.zeros(len(width))
            for k in np.unique(width).tolist():
                at = np.flatnonzero(width == k)
                unit = _unit(np.asarray(vector.take(pa.array(at)).flatten()).reshape(-1, k), greatest)
                for i in range(0, len(at), 2048):
                    dots = unit[i:i + 2048] @ pivots[k].T
                    cell[at[i:i + 2048]] = dots.argmax(1)
                    angle[at[i:i + 2048]] = _angle(dots.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return deal


def _route(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray], greatest: float, home: bool):
    """Of a chunk, the requests for each cell: their own (home), or all others that their bounds leave."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, data in zip(batch.column("width").to_pylist(), batch.column("data").to_pylist(), strict=True):
                rid, query, c = pickle.loads(data)
                if home:
                    go = np.arange(len(pivots[width]))[None] == c["own"][:, None]
                else:
                    low, high = _bounds(query.astype(float), greatest, pivots[width], np.maximum(radius[width], 0))
                    go = (high >= np.maximum(c["least"], c["floor"])[:, None]) & (low <= c["most"][:, None]) & (radius[width] >= 0)
                    go[np.arange(len(go)), c["own"]] = False
                for cell in np.flatnonzero(go.any(0)).tolist():
                    at = np.flatnonzero(go[:, cell])
                    part = pickle.dumps(([rid[i] for i in at.tolist()], query[at], {k: x[at] for k, x in c.items()}))
                    yield pa.record_batch([pa.array([width], pa.int32()), pa.array([cell], pa.int32()), pa.array([rid[at[0]]]), pa.array([part], pa.binary())], names=["width", "cell", "chunk", "requests"])

    return route


class _Space:
    """The candidates' trees, and what is known of their cells."""

    def __init__(self, classes: DataFrame):
        self.tasks = parts(classes.sparkSession)
        norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        sizes = classes.groupBy("width").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()
        self.greatest = float(np.sqrt(max([r.norm for r in sizes], default=0.0)))
        # a bounded number of pivots for each length, the vectors with the least hashes
        self.pivots = {}
        for r in sizes:
            some = classes.where(F.col("width") == r.width).orderBy(F.xxhash64("cls"), "cls").limit(min(PIVOTS, -(-r.n // BLOCK)))
            self.pivots[r.width] = _unit(np.array([x.vector for x in some.select("vector").collect()], float).reshape(-1, r.width), self.greatest)
        dealt = self.dealt(classes)
        # a radius for each cell, of which there are no more than pivots
        self.radius = {k: np.full(len(p), -1.0) for k, p in self.pivots.items()}
        for r in dealt.groupBy("width", "cell").agg(F.max("angle").alias("radius")).collect():
            self.radius[r.width][r.cell] = r.radius + 1e-7
        cells = dealt.groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = dealt.join(cells, ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        keys = ["width", "cell", "block"]
        self.trees = saved(dealt.repartition(self.tasks, *keys).groupBy(*keys).applyInArrow(_plant(self.greatest), "width int, cell int, block int, data binary"))

    def dealt(self, rows: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        return saved(rows.mapInArrow(_cells(self.pivots, self.greatest), f"{fields}, cell int, angle double"))

    def ask(self, requests: DataFrame, same: bool, home: bool) -> DataFrame:
        """rid, vec_id, score of the first rows of each request in the cells it is sent to."""
        many = requests.groupBy("width", "own").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        dealt = requests.join(many, ["width", "own"]).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")))
        chunks = dealt.groupBy("width", "own", "chunk").applyInArrow(_pack_requests, "width int, data binary")
        sent = chunks.mapInArrow(_route(self.pivots, self.radius, self.greatest, home), "width int, cell int, chunk string, requests binary")
        keys = ["width", "cell", "chunk", "block"]
        pairs = sent.join(self.trees, ["width", "cell"]).repartition(self.tasks, *keys)
        return pairs.groupBy(*keys).applyInArrow(_search(self.greatest, same), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    label = dict(vectors.dtypes)["label"]
    number = F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast(label)
    rows = vectors.where(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), shifted.alias("label"), number.alias("vector"))
    rows = rows.withColumn("width", F.size("vector")).withColumn("cls", F.sha2(F.to_json(F.struct("label", "vector")).cast("binary"), 256))
    rows = saved(rows)

    # of rows with one vector and label, those that can be among an anchor's first
    order = Window.partitionBy("cls").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_CLASS)
    classes = few.groupBy("cls").agg(F.any_value("label").alias("label"), F.any_value("width").alias("width"), F.any_value("vector").alias("vector"), F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))).alias("ids"))
    classes = saved(classes.select("cls", "label", "width", "vector", F.transform("ids", lambda x: x["vec_id"]).alias("ids")))
    space = _Space(classes)

    anchors = rows.where(F.col("vec_id") % ANCHORS == 0).groupBy("cls", "vec_id").agg(F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("label", "width", "vector")))
    anchors = space.dealt(anchors.withColumn("rid", F.concat_ws(" ", "cls", "vec_id")).withColumn("self_score", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).cast("bigint")))
    fields = ["width", "label", F.col("cell").alias("own"), "vector"]
    least, most = F.lit(NONE).cast("bigint"), F.lit((1 << 63) - 1).cast("bigint")
    found = _asked(space, anchors.select("rid", *fields, least.alias("least"), most.alias("most"), least.alias("floor")), True, PER_CLASS)

    # without the anchor's own row, which is one of those with its id and score, or behind PER_CLASS others
    of = found.join(anchors.select("rid", F.col("vec_id").alias("own_id"), "self_score"), "rid")
    of = of.withColumn("own", F.col("vec_id").eqNullSafe(F.col("own_id")) & (F.col("score") == F.col("self_score")))
    of = of.withColumn("nth", F.row_number().over(Window.partitionBy("rid", "own").orderBy("score")))
    positives = _first(of.where("not (own and nth = 1)").select("rid", "vec_id", "score"), FIRST)
    positives = saved(positives.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # an anchor asks once for each score that its positives have; below zero no score fits
    windows = positives.where("positive_score >= 0").select("anchor", "positive_score").distinct()
    lowest = F.ceil(F.col("positive_score").cast("decimal(24,0)") * LEAST_PERCENT / 100).cast("bigint")
    rid = F.concat_ws(" ", "anchor", "positive_score").alias("rid")
    windows = anchors.withColumnRenamed("rid", "anchor").join(windows, "anchor").select(rid, *fields, lowest.alias("least"), F.col("positive_score").alias("most"), lowest.alias("floor"))
    negatives = _first(_asked(space, saved(windows), False, FIRST), FIRST)
    negatives = negatives.select("rid", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    whose = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"), "copies")
    out = positives.withColumn("rid", rid).join(negatives, "rid").join(whose, "anchor")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _asked(space: _Space, requests: DataFrame, same: bool, need: int) -> DataFrame:
    """The requests' first rows: from their own cells, then from where better ones can be."""
    home = saved(_first(space.ask(requests, same, home=True), need))
    known = home.where(F.col("place") == need).select("rid", F.col("score").alias("known"))
    higher = requests.join(known, "rid", "left").withColumn("floor", F.greatest("floor", "known")).drop("known")
    more = _first(space.ask(higher, same, home=False), need)
    return saved(home.union(more).drop("place"))


#: The same in DuckDB SQL.
ORACLE = """
WITH r AS (SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.row_no AS a, a.vec_id AS anchor_id, c.row_no AS c, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON len(a.v) = len(c.v) AND a.row_no <> c.row_no WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id NULLS LAST))::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5
"""
