"""Benchmark decontamination with an FM-index per shard of training text.

The words of each shard (a few megabytes of whole documents) that the benchmark knows, in runs
long enough to hold a benchmark window, become one sequence of word numbers; other words cannot
be part of an occurrence. The shard's FM-index is the Burrows-Wheeler transform of that sequence,
its ranks in a wavelet matrix and every 8th suffix position. All windows of the benchmark are
searched backward at once, their rows are walked to sampled positions, and the occurrences of
each document are merged into spans.

The documents are read once and never shuffled; an extra column costs nothing. The benchmark is
counted first and sent to the tasks in blocks of at most ``BLOCK_WORDS`` words, one pass over the
documents each, so what a task holds is bounded whatever the benchmark's size.

Null and empty texts, and texts without words, are clean with no words. Benchmark rows without
words match nothing; rows sharing an item_id are one item, and rows whose item_id is null are one
item written as an empty string. Repeated documents each get their own row. With an empty
benchmark nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w

WINDOW = 13
#: Words of the benchmark that one pass over the documents searches for; about 32 MB in a task.
BLOCK_WORDS = 1 << 20
SHARD_BYTES = 8 << 20
SAMPLE = 8

_RESULT = "struct<n_words: bigint, spans: array<bigint>, items: array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """All suffixes of seq in order, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        placed = key[order]
        new = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane a level, the highest bit first."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.zeros, self.planes = [], []
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            before = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(bit == 0, out=before[1:])
            self.planes.append(before)
            self.zeros.append(int(before[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` of the sequence."""
        lo, hi = np.zeros_like(at), at
        for plane, zeros, level in zip(self.planes, self.zeros, reversed(range(self.bits)), strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            lo, hi = (np.where(one, zeros + x - plane[x], plane[x]) for x in (lo, hi))
        return hi - lo


class FMIndex:
    """Search and locate in a sequence of symbols 1..symbols-1; 0 is kept for its end."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.ranks = WaveletMatrix(self.bwt, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.sampled = np.where(order % sample == 0, order, -1)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.ranks.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row, and the one after the last, of the suffixes that begin with each phrase
        (one a row, all of one length)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            lo[alive], hi[alive] = self._step(symbol[alive], lo[alive]), self._step(symbol[alive], hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The position of each row's suffix: back along the sequence to a sampled one."""
        out = np.zeros(len(row), np.int64)
        todo, row, steps = np.arange(len(row)), row.copy(), 0
        while len(todo):
            have = self.sampled[row] >= 0
            out[todo[have]] = self.sampled[row[have]] + steps
            todo, row = todo[~have], row[~have]
            row = self._step(self.bwt[row], row)
            steps += 1
        return out


class Phrases:
    """The windows of some benchmark items as rows of word numbers, from 2 on, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found = w.find_words(*w.buffers(pa.array([t for _, t in items], pa.string())), w.ALNUM, w.LOWER)
        raw = found.data.tobytes()
        texts = [raw[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
        keys, where, number = np.unique(found.hashes(), return_index=True, return_inverse=True)
        self.keys, self.words = keys, [texts[i] for i in where]
        self.known = np.zeros(1 << 16, bool)
        self.known[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.ids = [i for i, _ in items]
        by_length: dict[int, list] = {}
        for k, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
            size = min(window, b - a)
            for i in range(a, b - size + 1) if size else ():
                by_length.setdefault(size, []).append((k, number[i:i + size] + 2))
        self.groups = []
        for size, rows in by_length.items():
            phrases, which = np.unique(np.array([p for _, p in rows]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), [k for k, _ in rows]], 1), axis=0)
            self.groups.append((size, phrases, np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)), pairs[:, 1]))
        self.shortest = min(by_length, default=0)

    def numbers(self, found: w.Words) -> np.ndarray:
        """Each word's number, or 1 for a word that is not the benchmark's."""
        out = np.ones(len(found.start), np.int64)
        h = found.hashes()
        at = np.flatnonzero(self.known[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[place] == h[at]
        out[at[same]] = place[same] + 2
        return out


def _runs(numbers: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of known words, within a text, of at least ``least`` words."""
    known = numbers > 1
    new = np.zeros(len(known) + 1, bool)
    new[first] = True
    begin = np.flatnonzero(known & (new[:-1] | ~np.concatenate([[False], known[:-1]])))
    end = np.flatnonzero(known & (new[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    keep = end - begin >= least
    return begin[keep], (end - begin)[keep]


def _occurrences(found: w.Words, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Word positions of occurrences and their phrases, length by length."""
    if not phrases.shortest or not len(found.start):
        return
    numbers = phrases.numbers(found)
    begin, length = _runs(numbers, found.first, phrases.shortest)
    if not len(begin):
        return
    # a run's words, then a 1 that no phrase has
    place = w.ranges(begin, length + 1)
    edge = np.cumsum(length + 1) - 1
    seq = np.ones(len(place), np.int64)
    inside = np.ones(len(place), bool)
    inside[edge] = False
    raw = found.data
    for i in np.flatnonzero(inside).tolist():
        k = numbers[place[i]]
        if raw[found.start[place[i]]:found.end[place[i]]].tobytes() == phrases.words[k - 2]:
            seq[i] = k
    index = FMIndex(seq, len(phrases.keys) + 2)
    for size, rows, items_from, items in phrases.groups:
        lo, hi = index.search(rows)
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(rows)), count)
        yield place[index.locate(w.ranges(lo, count))], which, size, items_from, items


def _scan(texts: pa.Array, earlier: list, phrases: Phrases) -> pa.Array:
    found = w.find_words(*w.buffers(texts), w.ALNUM, w.LOWER)
    hit = np.zeros(len(found.start) + 1, np.int64)
    items: list[set] = [set(x["items"]) if x else set() for x in earlier]
    for d, x in enumerate(earlier):
        if x:
            np.add.at(hit, found.first[d] + np.array(x["spans"][::2], np.int64), 1)
            np.add.at(hit, found.first[d] + np.array(x["spans"][1::2], np.int64), -1)
    for at, which, size, items_from, item in _occurrences(found, phrases):
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
        doc = np.searchsorted(found.first, at, "right") - 1
        for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            items[d].update(phrases.ids[k] for k in item[items_from[p]:items_from[p + 1]])
    covered = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
    out = []
    for d, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
        spans: list[int] = []
        if items[d]:
            inside = np.concatenate([[False], covered[a + 1:b + 1], [False]])
            spans = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
        out.append({"n_words": b - a, "spans": spans, "items": sorted(items[d])})
    return pa.array(out, _ARROW)


def _finder(items: list[tuple[str, str]], window: int):
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        phrases = Phrases(items, window)
        for texts, earlier in batches:
            done = [pa.array([], _ARROW)]
            at = 0
            for piece in w.pieces(texts, SHARD_BYTES):
                done.append(_scan(piece, earlier.slice(at, len(piece)).to_pylist(), phrases))
                at += len(piece)
            yield pa.concat_arrays(done)

    return F.arrow_udf(find, _RESULT).asNondeterministic()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def find_benchmark(docs: DataFrame, benchmark: DataFrame, result: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column ``result``: n_words; spans, the merged word ranges of benchmark
    occurrences as start, end, start, end, ...; items, the ids of the items that occur; n_hit,
    n_items, items_sha256 and contaminated."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = F.length("text") / 2 + 1  # no text has more words than this
    total = items.agg(F.sum(size)).first()[0] or 0
    n = int(total // block_words) + 1
    out = docs.withColumn(result, F.lit(None).cast(_RESULT))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        out = out.withColumn(result, _finder([(r.item_id, r.text) for r in block], window)("text", result))
    r = F.col(result)
    steps = F.sequence(F.lit(0), F.size(r.spans) - 2, F.lit(2))
    n_hit = F.when(F.size(r.spans) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, i: acc + r.spans[i + 1] - r.spans[i])).cast("bigint")
    out = out.withColumn(result, r.withField("n_hit", n_hit))
    return out.withColumn(result, r.withField("n_items", F.size(r["items"]).cast("bigint")).withField("items_sha256", F.sha2(F.array_join(F.array_sort(r["items"]), ","), 256)).withField("contaminated", (r.n_hit > 0) & (20 * r.n_hit >= r.n_words)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    named = docs.select("doc_id", "text")
    return find_benchmark(named, benchmark, "found").select("doc_id", *(f"found.{x}" for x in fields))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; the others unchanged."""
    name = free_name(docs, "found")
    return find_benchmark(docs, benchmark, name).where(~F.col(name)["contaminated"]).drop(name)


#: The same in DuckDB SQL.
ORACLE = r"""
WITH lower_case AS (SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
w AS (SELECT doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lower_case),
b AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS win
      FROM (SELECT item_id, words, least(len(words), 13) AS size, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS pos FROM w WHERE item_id IS NOT NULL AND len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM b),
d AS (SELECT doc_id, words FROM w WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, size, pos, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS win
      FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM d, sizes WHERE len(words) >= size)),
o AS (SELECT p.doc_id, p.pos, p.size, b.item_id FROM p JOIN b ON b.size = p.size AND b.win = p.win),
h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
