import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veloscore.llm import cover_tree, line_dedup, ngram_join, substring_dedup
from veloscore.llm.components import connected_components

SF_SMALL = "/root/testdata/sf0.001"


def table(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def brute_lines(data):
    windows = {}
    split = {(i, t): t.split("\n") for i, t in data if t is not None}
    order = sorted(split, key=lambda k: (k[0] is not None, k[0] or 0))
    gone = {k: set() for k in split}
    for k in order:
        for at in range(len(split[k]) - 2):
            if windows.setdefault(tuple(split[k][at:at + 3]), (k, at)) != (k, at):
                gone[k] |= {at, at + 1, at + 2}
    out = []
    for i, t in data:
        lines, g = split.get((i, t), []), gone.get((i, t), set())
        out.append((i, len(lines), len(g), None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in g)))
    return sorted(out, key=repr)


def test_line_dedup_is_brute_force(docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert table(line_dedup.line_dedup(docs), "doc_id", "n_lines", "n_removed", "text") == brute_lines(data)


def test_line_dedup_merges_runs(spark):
    a = "\n".join(f"l{i}" for i in range(10))
    df = spark.createDataFrame([(1, a), (2, "p\n" + a + "\nq\n" + a), (3, "same\n" * 6)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert got[1].n_removed == 0 and got[2].text == "p\nq" and got[2].n_removed == 20
    assert (got[3].doc_id, got[3].n_lines, got[3].n_removed, got[3].text) == brute_lines([(3, "same\n" * 6)])[0]


def test_line_dedup_has_no_python(docs):
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keep_first_lines_keeps_columns(docs):
    kept = line_dedup.keep_first_lines(docs)
    assert kept.columns == docs.columns and kept.count() > 0


def brute_windows(data, size=35):
    words = [(t or "").encode().split() for _, t in data]
    seen = Counter(tuple(x[k:k + size]) for x in words for k in range(len(x) - size + 1))
    out = []
    for (i, _), x in zip(data, words, strict=True):
        g = [False] * len(x)
        for k in range(len(x) - size + 1):
            if seen[tuple(x[k:k + size])] > 1:
                g[k:k + size] = [True] * size
        out.append((i, len(x), sum(g), hashlib.sha256(b" ".join(a for a, b in zip(x, g, strict=True) if not b)).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_of_repeated_rows_matches_sql(spark):
    """Rows equal in doc_id and text are one document: each gets the same result."""
    t = "alpha\nbeta\ngamma\ndelta"
    rows = [(1, t), (1, t), (2, t), (None, "x\n" + t), (None, "x\n" + t), (3, None), (3, None), (4, ""), (5, "alpha\nbeta"), (6, "q\n" * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    got = sorted(map(repr, map(tuple, line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_removed", "text").collect())))
    assert got == sorted(map(repr, con.sql(line_dedup.ORACLE).fetchall()))
    assert got.count(repr((1, 4, 4, ""))) == 2


def test_substring_dedup_is_brute_force(docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert table(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(data)


def test_substring_dedup_periodic_and_shared(spark):
    rng = np.random.default_rng(3)
    some = " ".join(rng.choice(list("abcdefgh"), 60))
    data = [(i, " ".join(rng.choice(list("abcdefgh"), 40)) + " " + some[k:] + " tail") for i, k in enumerate((0, 10, 30))] + [(9, "a b " * 60), (10, "z " * 36)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert table(substring_dedup.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(data)


def brute_components(data):
    def shingles(t):
        x = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(x[i:i + 5]) for i in range(max(1, len(x) - 4))} if x else set()

    sets = [shingles(t) for _, t in data]
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    out = []
    for k, (i, _) in enumerate(data):
        ids = [data[m][0] for m in range(len(data)) if part[m] == part[k] and data[m][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=repr)


def test_ngram_join_is_brute_force(docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert table(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == brute_components(data)


def test_ngram_join_chains_and_boundaries(spark):
    base = [f"t{i}" for i in range(60)]
    chain = [(k, " ".join(base[k * 3:k * 3 + 30])) for k in range(8)]  # 23 of 29 shingles shared with the next
    edge = [(100 + k, " ".join([f"u{i}" for i in range(20)] + [f"v{k}{i}" for i in range(k)])) for k in range(8)]
    data = chain + edge
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert table(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == brute_components(data)


def passed_over(seed):
    """Texts G, N and H: G and H link but have one prefix shingle in common, which comes late in H;
    it comes as late in N, whose size lies between theirs, so that N links with neither and every
    pair of neighbours in size fails the position filter."""
    rng = np.random.default_rng(seed)

    def shingle(words):
        return next(ngram_join.shingle_sets(pa.array([" ".join(words)])))[0]

    def grow(words, fits):
        while True:
            word = f"w{rng.integers(1 << 40)}"
            if fits(shingle([*words[-4:], word])):
                return [*words, word]

    g = [f"w{x}" for x in rng.integers(0, 1 << 40, 30)]
    first = min((shingle(g[k:k + 5]), k) for k in range(26))
    h, n = g, g[first[1]:first[1] + 5]
    for _ in range(8):
        h = grow(h, lambda x: x < first[0])
    for k in range(29):
        n = grow(n, (lambda x: x < first[0]) if k < 7 else (lambda x: x > first[0]))
    return [" ".join(x) for x in (g, n, h)]


def test_ngram_join_links_past_its_star_pairs(spark):
    data = [(10 * seed + k, text) for seed in range(12) for k, text in enumerate(passed_over(seed))]
    want = brute_components(data)
    assert all((10 * seed + 2, 34, 10 * seed) in want for seed in range(12))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert table(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == want


def test_keep_one_of_each(docs):
    kept = ngram_join.keep_one_of_each(docs)
    kept_rows = kept.collect()
    assert [r.text for r in kept_rows if r.doc_id is None] == [None]
    ids = sorted(r.doc_id for r in kept_rows if r.doc_id is not None)
    assert kept.columns == docs.columns and ids == [1, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15]


def brute_vectors(data):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())

    u = [unit(v) for _, v in data]
    linked = [[j for j, b in enumerate(u) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9] for i, a in enumerate(u)]
    out = []
    for i, (v, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            new = set(linked[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min((data[k][0] for k in seen if data[k][0] is not None), default=None)
        out.append((v, len(linked[i]), least, v == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 4096])
def test_cover_tree_is_brute_force(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    data = [(int(i), (centres[i % 12] + rng.normal(scale=0.25, size=6)).tolist()) for i in range(120)]
    data += [(500, data[3][1]), (500, data[3][1]), (501, [0.0] * 6), (502, None), (503, []), (504, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (505, [float("nan")] * 6), (506, [float("inf")] + [0.0] * 5), (507, [1.0, 2.0]), (508, [1.0, 2.1]), (None, data[3][1]), (509, [1e300] + [0.0] * 5), (510, [1e-300] + [0.0] * 5)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert table(cover_tree.near_duplicates(df, block=block), "vec_id", "n_links", "component_id", "kept") == brute_vectors(data)


def test_cover_tree_prunes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3)) * 0.02 + rng.normal(size=(30, 3)).repeat(30, 0) * 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.CoverTree(x)
    for k, radius in enumerate(tree.radius):
        assert (radius <= 2 * 0.5 ** k + 1e-9).all()
    pairs = np.zeros((900, 900), int)
    for kind, p, q in cover_tree.dual_traversal(x, tree, x, tree, 0.99, True):
        if kind == "vectors":
            np.add.at(pairs, (p, q), 1)
        else:
            for a, b in zip(p[1], q[1], strict=True):
                i = tree.order[tree.first[p[0]][a]:tree.first[p[0]][a + 1]]
                j = tree.order[tree.first[q[0]][b]:tree.first[q[0]][b + 1]]
                pairs[np.ix_(i, j)] += 1
    assert (pairs == (x @ x.T >= 0.99)).all()


def test_cover_tree_drops_far_blocks_before_vectors_travel(spark):
    """Forty tight clusters: only blocks of near cells are paired, and no linked pair is lost."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    data = [(i, (centres[i % 40] + rng.normal(scale=0.05, size=24)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("cls", F.lit("x")).withColumn("block", F.lit(1)).withColumn("links", F.lit(2)).withColumn("Vector", F.lit(3))
    assert table(cover_tree.near_duplicates(df, block=20), "vec_id", "n_links", "component_id", "kept") == brute_vectors(data)
    classes = df.select(F.col("vec_id").cast("string").alias("cls"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("vector"), F.lit(24).alias("width"))
    limit = float(np.sqrt(2 - 2 * 0.9))
    planted, near = cover_tree.planted_blocks(classes, 20, limit)
    blocks, pairs = planted.count(), cover_tree.block_pairs(planted, near, limit).count()
    assert blocks >= 80 and blocks <= pairs < 0.15 * blocks * (blocks + 1) / 2
    assert len(near) < 0.3 * 80 * 81 / 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len(got) == 101 and len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[0] != got[100]


def test_empty_tables(spark, empty):
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    for df in (line_dedup.line_dedup(empty), substring_dedup.remove_repeats(empty), ngram_join.near_duplicates(empty), cover_tree.near_duplicates(vectors)):
        assert df.collect() == []


def test_small_tables_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    from veloscore.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF_SMALL)
        want = con.sql(sql)
        names = sorted(got.columns)
        assert sorted(want.columns) == names, name
        mine = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
        theirs = sorted((tuple(dict(zip(want.columns, r, strict=True))[n] for n in names) for r in want.fetchall()), key=repr)
        assert mine == theirs, name


def test_cover_tree_search_holds_few_pairs_at_once():
    # no bound prunes these: all lie at nearly one distance, on both sides of the threshold
    import tracemalloc

    draw = np.random.default_rng(7)
    x = np.concatenate([np.full((1600, 1), 2.9), draw.normal(0, 0.125, (1600, 63))], 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.CoverTree(x)
    links = np.zeros(len(x), np.int64)
    tracemalloc.start()
    for kind, p, q in cover_tree.dual_traversal(x, tree, x, tree, 0.9, True):
        if kind == "vectors":
            np.add.at(links, p, 1)
        else:
            for a, b in zip(p[1], q[1], strict=True):
                a0, a1 = tree.first[p[0]][a:a + 2]
                b0, b1 = tree.first[q[0]][b:b + 2]
                links[tree.order[a0:a1]] += b1 - b0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = (np.einsum("ik,jk->ij", x, x) >= 0.9).sum(1)
    assert links.sum() > len(x) and abs(links - exact).max() <= 1
    assert peak < 120e6


def size_bits(df):
    """Binary digits of the size that Spark estimates of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


def test_estimated_sizes_do_not_grow_with_the_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)], "a bigint, b bigint")
    found = connected_components(edges, last=0)
    assert size_bits(found) < 64
    assert dict(table(found, "node", "root")) == dict.fromkeys(range(25), 0)


def test_sizes_of_links_are_those_of_their_files(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(k, " ".join(words[:30 + k % 9] + [f"x{k}"])) for k in range(30)]
    found = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert size_bits(found) < 1000


def test_components_of_rounds_and_of_the_last_edges(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(f"n{k}" for k in p) for p in rng.integers(0, 60, (40, 2)).tolist()]
    edges = spark.createDataFrame(pairs, "a string, b string")
    whole, rounds, mixed = (dict(table(connected_components(edges, last=n), "node", "root")) for n in (1 << 14, 0, 12))
    up = {x: {x} for p in pairs for x in p if p[0] != p[1]}
    for a, b in pairs:
        if a != b and up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    for got in (whole, rounds, mixed):
        assert got.keys() == up.keys()
        assert all((got[x] == got[y]) == (up[x] is up[y]) for x in up for y in up)


def test_levels_that_hardly_differ_are_skipped():
    rng = np.random.default_rng(5)
    limit = float(np.sqrt(0.2))
    x = rng.normal(size=(1500, 64))
    x[1200:] = x[:300] + 0.2 * rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.CoverTree(x).thinned(limit)
    paired = []
    def count(x, i, y, j, real=cover_tree._paired):
        paired.append(len(i))
        return real(x, i, y, j)
    have, cover_tree._paired = cover_tree._paired, count
    try:
        links = np.zeros((len(x), len(x)), bool)
        for kind, p, q in cover_tree.dual_traversal(x, tree, x, tree, 0.9, True):
            if kind == "vectors":
                links[p, q] = links[q, p] = True
                continue
            for a, b in zip(p[1].tolist(), q[1].tolist(), strict=True):
                u, v = (tree.order[tree.first[k][n]:tree.first[k][n + 1]] for k, n in ((p[0], a), (q[0], b)))
                links[np.ix_(u, v)] = links[np.ix_(v, u)] = True
    finally:
        cover_tree._paired = have
    assert (links == (x @ x.T >= 0.9)).all() and links.sum() > len(x)
    # of 2.25 million pairs few more than those that link are taken one by one
    assert sum(paired) < 30_000


def test_small_components_fill_few_partitions(spark):
    # each partition of each step is files of a shuffle, however few rows there are
    have = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").where("a % 20 <> 19")
        found = connected_components(edges)
        assert found.rdd.getNumPartitions() == 1
        roots = dict(table(found, "node", "root"))
    finally:
        for k, v in have.items():
            spark.conf.set(k, v)
    assert [len({roots[i] for i in range(a, a + 20)}) for a in (0, 20, 40)] == [1, 1, 1] and len(set(roots.values())) == 3


def on_disk(spark):
    """Bytes of shuffles and of what is written to the checkpoint folder."""
    from veloscore.session import checkpoint_root

    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(checkpoint_root(spark).removeprefix("file:"))
    return sum(p.stat().st_size for top in folders for p in Path(top).rglob("*") if p.is_file())


def test_cover_tree_disk_grows_with_the_vectors(spark):
    """Seventy blocks in general position, which no bound prunes: pairs of blocks are searched, not copied."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2800, 48))
    x[2500:] = x[:300] + 0.05 * rng.normal(size=(300, 48))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>").repartition(4).localCheckpoint()
    before = on_disk(spark)
    got = table(cover_tree.near_duplicates(df, block=40), "vec_id", "n_links", "kept")
    assert on_disk(spark) - before < 6 * x.nbytes
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    first = near.argmax(1)  # of these clusters of at most two
    assert got == sorted([(i, int(near[i].sum()) - 1, bool(first[i] == i)) for i in range(2800)], key=repr)


@pytest.mark.parametrize("repeated", [0, 30, 160])
def test_cover_tree_repeats_of_some_cells_and_of_all(spark, repeated):
    """Cells of which every vector is there often are joined by class before they are dealt, the others are not."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 10))
    data = [(i, (centres[i // 20] + rng.normal(scale=0.3, size=10)).tolist()) for i in range(160)]
    data += [(1000 * k + i, v) for k in range(1, 5) for i, v in data[:repeated]] + [(7, data[150][1])] * 2
    # one vector in each batch, so that no task can join its copies
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    have = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        got = table(cover_tree.near_duplicates(df, block=6), "vec_id", "n_links", "component_id", "kept")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", have)
    assert got == brute_vectors(data)


def test_nearest_pivot_is_one_in_any_batch():
    rng = np.random.default_rng(13)
    pivots = cover_tree._unit(rng.normal(size=(40, 16)))
    pivots[20:] = -pivots[:20]
    x = cover_tree._unit(rng.normal(size=(500, 16)))
    x[:250] -= (x[:250] @ pivots[0])[:, None] * pivots[0]  # as near to pivot 0 as to pivot 20, but for rounding
    pivots = pivots[[0, 20]]
    whole = cover_tree._nearest(x, pivots)[0]
    for size in (1, 3, 7, 64):
        assert (np.concatenate([cover_tree._nearest(x[i:i + size], pivots)[0] for i in range(0, 500, size)]) == whole).all()


def test_pairs_of_wide_balls_are_not_taken_one_by_one():
    # an upper level of wide balls with few children each, which no bound drops
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1200, 24))
    x[600:900] = x[:300] + 0.2 * rng.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, taken = cover_tree.CoverTree(x), []
    def count(x, i, y, j, real=cover_tree._paired):
        taken.append(len(i))
        return real(x, i, y, j)
    have, cover_tree._paired = cover_tree._paired, count
    try:
        links = np.zeros((len(x), len(x)), int)
        for kind, p, q in cover_tree.dual_traversal(x, tree, x, tree, 0.9, True):
            if kind == "vectors":
                np.add.at(links, (p, q), 1)
                continue
            for a, b in zip(p[1].tolist(), q[1].tolist(), strict=True):
                u, v = (tree.order[tree.first[k][n]:tree.first[k][n + 1]] for k, n in ((p[0], a), (q[0], b)))
                links[np.ix_(u, v)] += 1
    finally:
        cover_tree._paired = have
    assert (links == (x @ x.T >= 0.9)).all()
    assert sum(taken) < 50_000
