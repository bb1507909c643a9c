"""Exact removal of repeated word windows by super-k-mer partitioning.

The minimiser of a window of ``window`` words is its smallest hash of ``gram`` consecutive words.
Consecutive windows with one minimiser are a super-k-mer: their words travel once, as one packed
string, to the bucket of the minimiser, where all windows of the bucket are cut out, sorted and
counted. A window repeats only if its minimiser does, so blocks first ask which of their
minimisers occur elsewhere, and only those super-k-mers travel.

* Both questions go from blocks of documents to buckets (see ``blocks``). A block asks about one
  minimiser or one packed string once, so copies that hold a third of all rows cost one entry a
  block, and nothing larger than a block or a bucket is in one task.
* Buckets compare the words themselves; hashes only choose what travels.
* The documents are shuffled once; the three passes over them share that exchange.

Every row is a document of its own, also rows that repeat another or share a doc_id: a repeated
row's windows occur twice, so both rows lose them. Null and empty texts have no words, and texts
of fewer than ``window`` words have no window and stay. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .blocks import in_order, parts, with_block

WINDOW = 35
GRAM = 16
#: Super-k-mers that are looked at together, to bound memory.
_ABREAST = 1 << 15

_ASK = "bucket int, block int, data binary"
_ANSWER = "block int, bucket int, data binary"


def _find(table: pa.Table) -> w.Words:
    data, offsets = w.buffers(table.column("text"))
    return w.find_words(data, offsets, w.NOT_SPACE)


def _superkmers(words: w.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer, and whether the
    minimiser is in it more than once, as it must be if one of its windows repeats inside it."""
    at = w.starts_within(words.first, window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = w.sequence_hashes(words.hashes(), gram)
    least = w.sliding_min(grams, window - gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    lead = np.flatnonzero(new)
    start, count, least = at[lead], np.diff(np.append(lead, len(at))), least[lead]
    again = np.empty(len(start), bool)
    for a in range(0, len(start), _ABREAST):
        s = slice(a, a + _ABREAST)
        span = count[s] + window - gram
        same = grams[w.ranges(start[s], span)] == np.repeat(least[s], span)
        again[s] = np.add.reduceat(same, np.cumsum(span) - span, dtype=np.int64) > 1
    return start, count, least, again


def _by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """keys sorted by bucket: each bucket and its slice."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=n))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), slice(a, b)


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names.split())


def _distinct_keys(minimisers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minimisers, in the order in which buckets are asked, and how often each occurs here."""
    keys, times = np.unique(minimisers, return_counts=True)
    order = np.argsort(keys % np.uint64(n), kind="stable")
    return keys[order], times[order]


def _ask_minimisers(window: int, gram: int, n: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        keys, _ = _distinct_keys(_superkmers(_find(table), window, gram)[2], n)
        return _rows("bucket block data", [(b, block, keys[s].tobytes()) for b, s in _by_bucket(keys, n)])

    return ask


def _answer_minimisers(key: tuple, table: pa.Table) -> pa.Table:
    """For each question, a byte for each minimiser: whether another block asked for it too."""
    bucket, asked = key[0].as_py(), [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
    keys, times = np.unique(np.concatenate(asked), return_counts=True)
    shared = keys[times > 1]
    rows = [(block, bucket, np.isin(x, shared, kind="sort").tobytes()) for block, x in zip(table.column("block").to_pylist(), asked, strict=True)]
    return _rows("block bucket data", rows)


def _repeated(minimisers: np.ndarray, again: np.ndarray, answers: pa.Table, n: int) -> np.ndarray:
    """Which super-k-mers have a minimiser that occurs more than once, in them, in the block or elsewhere."""
    keys, times = _distinct_keys(minimisers, n)
    flags = in_order(answers, "bucket").column("data").to_pylist()
    shared = np.frombuffer(b"".join(flags), bool) | (times > 1) if len(keys) else np.zeros(0, bool)
    return again | np.isin(minimisers, keys[shared], kind="sort")


def _packed(words: w.Words, start: np.ndarray, count: np.ndarray, minimisers: np.ndarray, window: int, n: int):
    """The distinct packed strings of super-k-mers, sorted by bucket; how often each occurs here
    and its number of windows; and for each super-k-mer its string's place."""
    raw = words.data.tobytes()
    s, e = words.start, words.end
    strings = [b" ".join(raw[s[i]:e[i + c + window - 2]].split()) for i, c in zip(start.tolist(), count.tolist(), strict=True)]
    bucket = (minimisers % np.uint64(n)).tolist()
    order = {x: i for i, x in enumerate(sorted(set(zip(bucket, strings, strict=True))))}
    place = np.array([order[x] for x in zip(bucket, strings, strict=True)], np.int64)
    return list(order), np.bincount(place, minlength=len(order)), place


def _ask_windows(window: int, gram: int, n: int):
    def ask(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows("bucket block data", [])
        block = key[0].as_py()
        words = _find(docs)
        start, count, least, again = _superkmers(words, window, gram)
        keep = _repeated(least, again, answers, n)
        strings, times, _ = _packed(words, start[keep], count[keep], least[keep], window, n)
        edges = np.flatnonzero(np.diff([b for b, _ in strings], prepend=-1, append=n)) if strings else []
        rows = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            data = w.pack(string=pa.array([x for _, x in strings[a:z]], pa.binary()), times=np.minimum(times[a:z], 2))
            rows.append((strings[a][0], block, data))
        return _rows("bucket block data", rows)

    return ask


def _windows(packed: bytes, window: int) -> list[bytes]:
    parts_ = packed.split(b" ")
    return [b" ".join(parts_[i:i + window]) for i in range(len(parts_) - window + 1)]


def _answer_windows(window: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """For each question, for each packed string, a bit for each window that occurs twice."""
        bucket, blocks = key[0].as_py(), table.column("block").to_pylist()
        asked = [w.unpack(x) for x in table.column("data").to_pylist()]
        total: dict[bytes, int] = {}
        for x in asked:
            for s, t in zip(x.column("string").to_pylist(), x.column("times").to_pylist(), strict=True):
                total[s] = total.get(s, 0) + t
        every = sorted((v, t) for s, t in total.items() for v in _windows(s, window))
        twice = {v for i, (v, t) in enumerate(every) if t > 1 or (i and every[i - 1][0] == v) or (i + 1 < len(every) and every[i + 1][0] == v)}
        del every
        mask = {s: sum(1 << i for i, v in enumerate(_windows(s, window)) if t > 1 or v in twice) for s, t in total.items()}
        rows = []
        for block, x in zip(blocks, asked, strict=True):
            strings = x.column("string").to_pylist()
            rows.append((block, bucket, w.pack(mask=pa.array([_bits(mask[s]) for s in strings], pa.binary()))))
        return _rows("block bucket data", rows)

    return answer


def _bits(mask: int) -> bytes:
    return mask.to_bytes((mask.bit_length() + 7) // 8, "little")


def _remove(window: int, gram: int, n: int):
    def remove(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        words = _find(docs)
        kinds = np.array(answers.column("kind").to_pylist(), np.int64)
        start, count, least, again = _superkmers(words, window, gram)
        keep = _repeated(least, again, answers.filter(pa.array(kinds == 0)), n)
        start, count, least = start[keep], count[keep], least[keep]
        _, _, place = _packed(words, start, count, least, window, n)
        masks = [m for x in in_order(answers.filter(pa.array(kinds == 1)), "bucket").column("data").to_pylist() for m in w.unpack(x).column("mask").to_pylist()]
        hit = np.zeros(len(words.start) + 1, np.int64)
        for i, p in zip(start.tolist(), place.tolist(), strict=True):
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(masks[p], np.uint8), bitorder="little"))
            np.add.at(hit, i + bits, 1)
            np.add.at(hit, i + bits + window, -1)
        gone = np.cumsum(hit[:-1]) > 0
        raw, first = words.data.tobytes(), words.first
        lost = np.concatenate([[0], np.cumsum(gone)])
        n_removed = lost[first[1:]] - lost[first[:-1]]
        texts = []
        for d in range(docs.num_rows):
            a, b = int(first[d]), int(first[d + 1])
            some = raw[words.start[a]:words.end[b - 1]].split() if b > a else []
            if n_removed[d]:
                some = [x for x, g in zip(some, gone[a:b].tolist(), strict=True) if not g]
            texts.append(b" ".join(some))
        kept = pa.array(texts, pa.binary()).cast(pa.string())
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept_sha256": sha, "kept_text": kept})

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept_text.

    kept_text is the words left, joined by one space. ``with_text=False`` leaves it out.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    n = parts(docs.sparkSession)
    named = docs.select("doc_id", "text")
    # one plan for all passes, so that they share one exchange
    dealt = with_block(named, F.xxhash64("doc_id", "text"), n).groupBy("block")
    asked = dealt.applyInArrow(_ask_minimisers(window, gram, n), _ASK)
    answers = asked.groupBy("bucket").applyInArrow(_answer_minimisers, _ANSWER)
    strings = dealt.cogroup(answers.groupBy("block")).applyInArrow(_ask_windows(window, gram, n), _ASK)
    masks = strings.groupBy("bucket").applyInArrow(_answer_windows(window), _ANSWER)
    both = answers.withColumn("kind", F.lit(0)).union(masks.withColumn("kind", F.lit(1)))
    out = dealt.cogroup(both.groupBy("block")).applyInArrow(_remove(window, gram, n), f"doc_id {dict(named.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


#: The same in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 34), ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM d WHERE len(words) >= 35)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY win) AS n FROM p) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM r),
l AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
k AS (SELECT l.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY l.pos) FILTER (g.pos IS NULL) AS kept
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
