"""The transducer and its table against Python's regular expressions, and the audit against SQL."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from veloscore.llm import filter_audit as fa

TEXTS = [None, "", " \t\n", "a", "a a A", "é 😀 é# $A", "x" * 50, " lead", "trail ", "\x0bv\x0cf\x1f", "word " * 300, "ÀB C"]


def plainly(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    t = text or ""
    return (len(words), len(set(words)), len(t), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)))


def mixed(n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice(["a", "b", "ab", " ", "\n", "é", "😀", "A", "#", "\x1f"]) for _ in range(draw.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, fa.SLICE])
def test_counts_in_slices_of_any_size(monkeypatch, size):
    monkeypatch.setattr(fa, "SLICE", size)
    texts = TEXTS + mixed(120) + ["".join(mixed(40, 9))]
    found = fa.count_texts(pa.array(texts, pa.string()))
    assert list(zip(*(found[c].tolist() for c in fa.COUNTS), strict=True)) == [plainly(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(fa.w.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    monkeypatch.setattr(fa.w, "mix", lambda x: np.zeros(len(x), np.uint64))
    texts = mixed(20)
    assert fa.count_texts(pa.array(texts))["n_distinct"].tolist() == [plainly(t)[1] for t in texts]


def brute(docs, labels):
    """docs: (doc_id, text, source), labels: (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, s in docs:
        n, d, points, capitals, symbols = plainly(t)
        fails = {"A": n < 200, "B": 100 * d < 50 * n, "C": 100 * capitals > 2 * points, "D": symbols > 0, "E": i is not None and least[t or ""] < i}
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels) and i is not None for k in (1, 2))
        parts.setdefault(s or "", []).append((fails, good, toxic))
    out = []
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                removed_by[f] += len(gone)
                every = sum(r[0][f] for r in rows)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                steps.append((part, "".join(order), step, len(left), len(gone), every - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return sorted(out)


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (99, 1, 1), (5, 0, 1)]


def test_audit_against_brute_force_and_sql(spark, docs, empty):
    long = " ".join(f"w{i}" for i in range(400))
    more = [(20 + i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)] + [(i, long, "c") for i in (50, 40, 40, None, 60)] + [(70, long + " #", ""), (71, long, None)]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()] + more
    documents = docs.select("doc_id", "text", "source", "kind", "size").unionByName(spark.createDataFrame(more, "doc_id bigint, text string, source string"), allowMissingColumns=True).withColumnRenamed("size", "part").withColumnRenamed("kind", "mask")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = sorted(map(tuple, fa.audit(documents.repartition(3), labels).collect()))
    assert got == brute(rows, LABELS)
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    con.register("labels", labels.toArrow())
    assert got == sorted(con.sql(fa.ORACLE).fetchall())
    assert fa.audit(empty, labels).collect() == []
    assert {r.good_lost for r in fa.audit(documents, labels.limit(0)).collect()} == {0}


def test_profile_keeps_columns(spark):
    df = spark.createDataFrame([(1, "A b b", "x")], "doc_id bigint, text string, n string")
    assert fa.profile(df, "doc_id", "n").collect() == [(1, "x", 3, 2, 5, 1, 0)]
