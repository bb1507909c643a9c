"""How five quality filters interact, over every order in which they can be applied.

1. A table-driven transducer reads each text's UTF-8 bytes once. A byte's class and the state (in a
   word or not) give the next state and what is emitted: a word's begin or end, a code point, a
   capital, a symbol. The next state depends on the byte's class alone, so a whole slice of bytes is
   stepped with two table lookups. Word spans go into an open-addressed hash table that is verified:
   a span counts as known only if it has the bytes of the span that the table holds, so a collision
   of hashes never hides a word.
2. The counts give each document the filters that it fails, as bits. Copies are found with a sum for
   each text before any join: of one text in one part with one set of labels a single row travels,
   however many documents hold it.
3. What an order of filters does depends only on how many documents fail which filters. Each part
   needs 32 such counts, from which all steps of all orders are looked up; documents never meet
   orders.

Defined results: a null text is empty; a null source is the empty string, one part with it. Rows are
rows: rows that repeat a doc_id each count, and a copy of a text under the same doc_id is no smaller
one. A null doc_id is no copy of any and has no labels. A document has a label if any of its rows in
``labels`` has. Very long texts are read in slices and never cut; what is held of one is its bytes and its distinct words'
bounds. Extra columns are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w
from .blocks import saved

FILTERS = "ABCDE"
#: Bytes that are stepped together.
SLICE = 4 << 20

# The transducer. Classes of bytes:
SPACE, PLAIN, CAPITAL, SYMBOL, FOLLOWING = range(5)
# what it emits:
BEGIN, END, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    out = np.full(256, PLAIN, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[ord("A"):ord("Z") + 1] = CAPITAL
    out[list(b"#$%&*|")] = SYMBOL
    out[0x80:0xC0] = FOLLOWING  # the second to fourth byte of a code point
    return out


CLASS = _classes()
#: The state after a byte of each class: 0 between words, 1 in one.
NEXT = np.array([0, 1, 1, 1, 1], np.uint8)
#: What a byte of each class emits, in either state.
EMIT = np.array([
    [POINT, BEGIN | POINT, BEGIN | POINT | IS_CAPITAL, BEGIN | POINT | IS_SYMBOL, BEGIN],
    [END | POINT, POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, 0],
], np.uint8)


def transduce(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps through texts that lie one after the other. For each slice: the bounds of the words that
    end in it, and the code points, capitals and symbols of each text in it (one row a text)."""
    ends_of_texts = np.unique(offsets[1:][np.diff(offsets) > 0])
    state, open_word = 0, np.zeros(0, np.int64)
    for a in range(0, len(data), SLICE):
        cls = CLASS[data[a:a + SLICE]]
        after = NEXT[cls]
        before = np.empty_like(after)
        before[0], before[1:] = state, after[:-1]
        stops = ends_of_texts[(ends_of_texts > a) & (ends_of_texts <= a + len(cls))] - a
        before[stops[stops < len(cls)]] = 0  # a text begins between words
        out = EMIT[before, cls]
        starts = np.concatenate([open_word, np.flatnonzero(out & BEGIN) + a])
        ends = np.sort(np.concatenate([np.flatnonzero(out & END), stops[after[stops - 1] == 1]])) + a
        here = np.clip(offsets - a, 0, len(cls))
        counts = []
        for what in (POINT, IS_CAPITAL, IS_SYMBOL):
            sums = np.zeros(len(cls) + 1, np.int32)
            np.cumsum((out & what) != 0, out=sums[1:])
            counts.append(np.diff(sums[here]))
        yield starts[:len(ends)], ends, np.array(counts, np.int64).T
        open_word = starts[len(ends):]
        closed = len(stops) > 0 and stops[-1] == len(cls)
        state = 0 if closed else int(after[-1])


class SpanTable:
    """Distinct words of texts, by open addressing with verification. A word is an owner (its text)
    and a span of the data; slots hold indices of the spans entered so far."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.start, self.end, self.owner = (np.zeros(0, np.int64) for _ in range(3))
        self.hash = np.zeros(0, np.uint64)
        self.slots = np.full(16, -1, np.int64)

    def _place(self, ids: np.ndarray, verify: bool) -> np.ndarray:
        """Puts spans, in order, into their slots; returns those that found an equal one there."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (self.hash[ids] & mask).astype(np.int64)
        known = []
        while len(ids):
            free = self.slots[slot] < 0
            self.slots[slot[free][::-1]] = ids[free][::-1]  # of several, the first stays
            held = self.slots[slot]
            done = held == ids
            if verify:
                equal = ~done & self._equal(held, ids)
                known.append(ids[equal])
                done |= equal
            ids, slot = ids[~done], (slot[~done] + 1) & int(mask)
        return np.concatenate(known) if known else ids

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = self.end[a] - self.start[a]
        out = (a != b) & (self.owner[a] == self.owner[b]) & (size == self.end[b] - self.start[b]) & (self.hash[a] == self.hash[b])
        at = np.flatnonzero(out)
        total = np.cumsum(size[at])
        i = 0
        while i < len(at):  # a bounded number of bytes at a time, or one longer word
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
            some = at[i:j]
            if j == i + 1:
                n = int(size[some[0]])
                x, y = int(self.start[a[some[0]]]), int(self.start[b[some[0]]])
                out[some] = np.array_equal(self.data[x:x + n], self.data[y:y + n])
            else:
                x, y = (w.ranges(self.start[k[some]], size[some]) for k in (a, b))
                differ = self.data[x] != self.data[y]
                out[some] = ~np.logical_or.reduceat(differ, np.cumsum(size[some]) - size[some])
            i = j
        return out

    def insert(self, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The owners of the words that were new."""
        old, n = len(self.start), len(start)
        if not n:
            return owner
        word = w.Words(self.data, start, end, np.array([0, n])).hashes()
        fresh = w.mix(word ^ w.mix(owner.astype(np.uint64) + np.uint64(1)))
        self.start, self.end, self.owner = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.owner, owner)))
        self.hash = np.concatenate([self.hash, fresh])
        if 2 * (old + n) > len(self.slots):
            self.slots = np.full(1 << (4 * (old + n) - 1).bit_length(), -1, np.int64)
            self._place(np.arange(old), verify=False)
        known = self._place(np.arange(old, old + n), verify=True)
        keep = np.ones(old + n, bool)
        keep[known] = False
        number = np.cumsum(keep) - 1
        self.slots = np.where(self.slots < 0, -1, number[self.slots])
        self.start, self.end, self.owner, self.hash = (x[keep] for x in (self.start, self.end, self.owner, self.hash))
        return owner[keep[old:]]


COUNTS = ("n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    out = {c: [np.zeros(0, np.int64)] for c in COUNTS}
    for piece in w.pieces(texts, SLICE):
        data, offsets = w.buffers(piece)
        n = len(offsets) - 1
        table, sums = SpanTable(data), np.zeros((n, 3), np.int64)
        words, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for start, end, counts in transduce(data, offsets):
            owner = np.searchsorted(offsets, start, "right") - 1
            words += np.bincount(owner, minlength=n)
            distinct += np.bincount(table.insert(start, end, owner), minlength=n)
            sums += counts
        for c, x in zip(COUNTS, (words, distinct, *sums.T), strict=True):
            out[c].append(x)
    return {c: np.concatenate(x) for c, x in out.items()}


def profile(docs: DataFrame, *keep: str) -> DataFrame:
    """COUNTS of every text of docs(text), beside the columns to keep."""
    kept = docs.select(*keep)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_texts(batch.column(batch.num_columns - 1))
            yield pa.record_batch([*batch.columns[:-1], *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*keep, *COUNTS])

    fields = [f"`{c}` {t}" for c, t in kept.dtypes] + [f"{c} bigint" for c in COUNTS]
    return docs.select(*keep, F.col("text").alias("text")).mapInArrow(counted, ", ".join(fields))


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _failures() -> Column:
    """Bits of the filters A to D that a profiled text fails."""
    fails = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 2 * n_points", "D": "n_symbols > 0"}
    return sum((F.when(F.expr(c), _bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters of the mask,
    and how many of them have quality or toxic labels."""
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sum"), "text")
    seen = profile(named, "doc_id", "part", "sum").select("doc_id", "part", "sum", _failures().alias("mask"))
    # rows that repeat are one row with a count before anything is joined
    seen = saved(seen.groupBy("doc_id", "part", "sum", "mask").agg(F.count("*").alias("n")))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"is_{c}") for c in ("quality", "toxic")))
    marked = seen.where("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["is_quality", "is_toxic"])
    nameless = seen.where("doc_id is null").withColumn("is_quality", F.lit(0)).withColumn("is_toxic", F.lit(0))
    keys = ["sum", "part", "mask", "is_quality", "is_toxic"]
    # of all rows with one text, part and labels: how many, the least id, and how many have that
    groups = saved(marked.unionByName(nameless).groupBy(*keys, F.col("doc_id").isNull().alias("nameless")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")))
    first = groups.where("not nameless").groupBy("sum").agg(F.min("least").alias("first"))
    copies = F.expr("case when nameless then 0 when least = first then n - n_least else n end")
    told = groups.join(first, "sum", "left").select("part", "is_quality", "is_toxic", "mask", "n", copies.alias("copies"))
    both = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + _bit("E")).alias("mask"), F.col("copies").alias("n")))
    each = told.select("part", "is_quality", "is_toxic", F.inline(both))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_quality")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> one row for each part, order of
    the filters and step."""
    counts = failures(docs, labels)

    def passing(column: str) -> Column:
        """By set of filters: how many pass all of them."""
        return F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(column)).otherwise(0)) for s in range(1 << len(FILTERS))))

    def by_filter(value) -> Column:
        return F.array(*(F.sum(value(_bit(k))) for k in FILTERS))

    fails = lambda b: F.when(F.col("mask").bitwiseAND(b) != 0, F.col("n")).otherwise(0)
    only = lambda b: F.when(F.col("mask") == b, F.col("n")).otherwise(0)
    orders = ["".join(p) for p in permutations(FILTERS)]
    # a document that fails k filters is removed by each of them in 1 of k orders
    share = lambda b: fails(b) * (len(orders) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("bigint")
    parts = counts.groupBy("part").agg(
        passing("n").alias("n"), passing("good").alias("good"), passing("toxic").alias("toxic"),
        by_filter(fails).alias("fails"), by_filter(only).alias("only"), by_filter(share).alias("share"))
    rows = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def chosen(steps: Column) -> Column:
        """The filters of the first steps, as bits."""
        head = F.substr("filter_order", F.lit(1), steps)
        return sum((F.when(F.instr(head, k) > 0, _bit(k)).otherwise(0) for k in FILTERS), F.lit(0))

    own = F.instr(F.lit(FILTERS), F.substr("filter_order", F.col("step"), F.lit(1))) - 1
    rows = rows.select("*", chosen(F.col("step") - 1).alias("before"), chosen(F.col("step")).alias("after"), own.alias("own"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    out = {
        "kept": F.get("n", F.col("after")), "removed": lost("n"), "redundant": F.get("fails", F.col("own")) - lost("n"),
        "unique_fails": F.get("only", F.col("own")), "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": F.get("share", F.col("own")),
    }
    return rows.select("part", "filter_order", "step", *(v.cast("bigint").alias(k) for k, v in out.items()))


#: The same in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic,
        (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(f.doc_id > min(f.doc_id) OVER (PARTITION BY t), false)::INT AS mask
      FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(quality) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
a AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS x),
p AS (SELECT a1.x || a2.x || a3.x || a4.x || a5.x AS filter_order FROM a a1, a a2, a a3, a a4, a a5
      WHERE len(list_distinct([a1.x, a2.x, a3.x, a4.x, a5.x])) = 5),
s AS (SELECT filter_order, step, list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(substr(filter_order, i, 1)) - 65))::INT)) AS earlier,
        (1 << (ascii(substr(filter_order, step, 1)) - 65))::INT AS own FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM p)),
r AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0)::INT | own) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & own > 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & coalesce(earlier, 0)::INT > 0 AND mask & own > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & own > 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & own > 0), 0) AS toxic_lost
      FROM s, c GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
