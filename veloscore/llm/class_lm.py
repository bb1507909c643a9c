"""Language-model scoring with Brown class-based n-grams.

    P(word | word before) = P(class | class before) * P(word | class)

Every word of the training documents, to the last, is in one class, found by exchange: as in Brown's
scheme the most frequent words begin as classes of their own and all others as one more. In a
sweep, every word moves to the class that makes the training texts most likely, given how often it
follows and precedes the words of each class; class counts are then taken anew from all training
texts. Sweeps go on until one gains less than GAIN nats a token; the best of them is kept, and
``sweeps`` in the result says how many were made. Ends of texts are class 0, alone.

Class transitions are smoothed by the classes' own shares. A word that training has not seen is in
a class of its own, whose probability after any class is the share of words seen once.

Texts are read once, into blocks of bounded size: their tokens as numbers of the block's own
distinct words. Words are dealt into buckets, each holding its part of the dictionary and its words'
classes. In a sweep each block is told its words' classes, and gives each bucket its words' counts
by class before and after, packed, so a word that a third of all texts hold costs one entry a
block and class. Classes told to the blocks are broadcast up to TOLD bytes, joined by block beyond. The
driver gets the table of classes, the first words and sums, all of fixed size.

Null and empty texts have one token, their end; very long texts are taken whole, each a block of its own
beyond the bound. Rows that repeat are texts of their own, also in training. A null doc_id is held out.
Without training texts every word is unknown and the base score of a token is log10(0.1 / 0.1) = 0.
Extra columns are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w
from .blocks import parts, saved, written

TRAINING_SHARE = 10
CLASSES = 64
#: Nats a token that a sweep has to gain for another to follow.
GAIN = 0.01
#: The weight of a class's own share against its bigrams.
BIGRAM_PRIOR = 4.0
#: Tokens in a block.
BLOCK = 1 << 20
#: Bytes of told classes that are broadcast.
TOLD = 32 << 20
#: Words of a bucket whose counts are looked at together.
ABREAST = 1 << 16
PIECE = 4 << 20
#: The class of words that training has not seen, as a bucket writes it.
UNSEEN = 255


def held_out(doc_id: Column) -> Column:
    """True for documents that training never sees: crc32(doc_id as text) mod 10 is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(TRAINING_SHARE)) == 0, F.lit(True))


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of some texts in order, and where each text's begin (n + 1 numbers)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(w.compact(texts)))
    flat, offsets = lists.values, np.asarray(lists.offsets)
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    some = np.asarray(pc.not_equal(flat, ""), bool)  # white space at either end gives an empty word
    before = np.concatenate([[0], np.cumsum(some)])
    return flat.filter(pa.array(some)), before[offsets - offsets[0]]


def _bucket_of(words: pa.Array, n: int) -> np.ndarray:
    data, offsets = w.buffers(words)
    return (w.Words(data, offsets[:-1], offsets[1:], np.array([0, len(words)])).hashes() % np.uint64(n)).astype(np.int64)


def _in_order(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words by code point, and the place of each word among them."""
    coded = words.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[np.asarray(coded.indices, np.int64)]


_BLOCKS = "block string, ids array<{0}>, held array<boolean>, sizes binary, tokens binary, words binary, buckets binary"


def _read(n: int, kind: pa.DataType):
    """Blocks of documents: ids, tokens of each, the tokens as numbers of the block's words, the words with
    their training counts, and their buckets."""
    def block(ids: list, held: list, sizes: list, words: list) -> pa.RecordBatch:
        ids, held, sizes = pa.concat_arrays(ids), np.concatenate(held), np.concatenate(sizes)
        distinct, local = _in_order(pa.concat_arrays(words))
        times = np.bincount(local[np.repeat(~held, sizes)], minlength=len(distinct))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.record_batch([
            pa.array([uuid.uuid4().hex]), one(ids), one(pa.array(held)), pa.array([w.pack(size=sizes)], pa.binary()),
            pa.array([w.pack(low=(local & 0xFFFF).astype(np.uint16), high=(local >> 16).astype(np.uint32))], pa.binary()),
            pa.array([w.pack(word=distinct, times=times)], pa.binary()), pa.array([w.pack(bucket=_bucket_of(distinct, n).astype(np.int32))], pa.binary()),
        ], names=["block", "ids", "held", "sizes", "tokens", "words", "buckets"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: tuple[list, ...] = ([], [], [], [])
        count = 0
        for batch in batches:
            at = 0
            for piece in w.pieces(batch.column("text"), PIECE):
                words, first = tokens(piece)
                rows = slice(at, at + len(piece))
                at += len(piece)
                for x, new in zip(have, (batch.column("doc_id").cast(kind)[rows], np.asarray(batch.column("held_out")[rows], bool), np.diff(first), words), strict=True):
                    x.append(new)
                count += len(words) + len(piece)
                if count >= BLOCK:
                    yield block(*have)
                    have, count = ([], [], [], []), 0
        if have[0]:
            yield block(*have)

    return read


def _sequence(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a block, ends included: its document and its word (-1 for an end); and whether
    each document is held out."""
    size = w.column(w.unpack(row["sizes"]), "size")
    packed = w.unpack(row["tokens"])
    word = np.full(int(size.sum()) + len(size), -1)
    inside = np.ones(len(word), bool)
    inside[np.cumsum(size + 1) - 1] = False
    word[inside] = w.column(packed, "low").astype(np.int64) + (w.column(packed, "high").astype(np.int64) << 16)
    return np.repeat(np.arange(len(size)), size + 1), word, np.array(row["held"], bool)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's words and training counts, to the words' buckets."""
    for batch in batches:
        for row in _rows(batch):
            have, bucket = w.unpack(row["words"]), w.column(w.unpack(row["buckets"]), "bucket")
            word, times = have.column("word"), w.column(have, "times")
            some = np.unique(bucket)
            data = [w.pack(word=word.take(pa.array(at)), times=times[at]) for at in (np.flatnonzero(bucket == b) for b in some.tolist())]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some)), pa.array(data, pa.binary())], names=["bucket", "block", "data"])


_KNOWN = "kind int, bucket int, block string, times long, seen long, once long, data binary"


def _sum_words(top: int):
    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a bucket's words with their counts. Kind 1: of each block that asked, the places of its
        words among them. Kind 2: its most frequent words, their counts and places."""
        blocks, words, times = [], [], []
        for batch in batches:
            blocks += batch.column("block").to_pylist()
            for x in batch.column("data").to_pylist():
                have = w.unpack(x)
                words.append(have.column("word"))
                times.append(w.column(have, "times"))
        word, place = _in_order(pa.concat_arrays(words))
        total = np.bincount(place, np.concatenate(times), len(word)).astype(np.int64)
        cut = np.cumsum([len(x) for x in words])[:-1]
        rows = [(0, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), w.pack(word=word, times=total))]
        rows += [(1, b, None, None, None, w.pack(place=x.astype(np.int32))) for b, x in zip(blocks, np.split(place, cut), strict=True)]
        first = np.argsort(-total, kind="stable")[:top]  # ties by code point
        rows += [(2, word[int(i)].as_py(), int(total[i]), int(i), None, None) for i in first if total[i]]
        kind, block, n, seen, once, data = zip(*rows, strict=True)
        yield pa.record_batch([pa.array(kind, pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(block, pa.string()), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(once, pa.int64()), pa.array(data, pa.binary())], names=[c.split()[0] for c in _KNOWN.split(", ")])

    return add


def _held(table: pa.Table) -> tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray | None]:
    """Of a bucket's known rows: its words, the places of each block's words, and its classes."""
    words, place, cls = None, {}, None
    for kind, block, data in zip(*(table.column(c).to_pylist() for c in ("kind", "block", "data")), strict=True):
        if kind == 0:
            words = w.unpack(data)
        elif kind == 1:
            place[block] = w.column(w.unpack(data), "place")
        elif kind == 3:
            cls = np.frombuffer(data, np.uint8)
    return words, place, cls


def _tell(key: tuple, table: pa.Table) -> pa.Table:
    """For each block that asked a bucket: its words' classes and counts."""
    words, place, cls = _held(table)
    times = w.column(words, "times")
    blocks = sorted(place)
    return pa.table({
        "block": pa.array(blocks, pa.string()), "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int32()),
        "cls": pa.array([w.pack(cls=cls[place[b]]) for b in blocks], pa.binary()), "times": pa.array([w.pack(times=times[place[b]]) for b in blocks], pa.binary())})


def _told(row: dict, what: str) -> np.ndarray:
    """What a block was told of its words, in their order."""
    bucket = w.column(w.unpack(row["buckets"]), "bucket")
    out = np.zeros(len(bucket), np.int64)
    for x in row["told"]:
        out[bucket == x["bucket"]] = w.column(w.unpack(x[what]), what)
    return out


_COUNTS = "bucket int, block string, data binary"


def _count(classes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a block's training texts: to each bucket its words' counts by class before and after, and
        under bucket -1 the table of classes."""
        k = classes
        for batch in batches:
            for row in _rows(batch):
                doc, word, held = _sequence(row)
                word = word[~held[doc]]
                bucket = w.column(w.unpack(row["buckets"]), "bucket")
                of_word = np.append(_told(row, "cls"), 0)  # the last for ends, -1
                now = of_word[word]
                before, after = np.zeros_like(now), np.zeros_like(now)
                before[1:], after[:-1] = now[:-1], now[1:]
                table = np.bincount(before * k + now, minlength=k * k)
                at = word >= 0
                codes, many = np.unique(np.concatenate([word[at] * 2 * k + before[at], word[at] * 2 * k + k + after[at]]), return_counts=True)
                mine = codes // (2 * k)
                order = np.argsort(bucket, kind="stable")
                start = np.searchsorted(bucket[order], bucket[order])
                place = np.empty(len(bucket), np.int64)
                place[order] = np.arange(len(bucket)) - start  # a word's place in what its bucket was asked
                codes += (place[mine] - mine) * 2 * k
                by = np.argsort(bucket[mine], kind="stable")
                some, cut = np.unique(bucket[mine][by], return_index=True)
                ends = np.append(cut, len(by))[1:].tolist()
                data = [w.pack_sorted(codes[by[a:b]], many[by[a:b]].astype(np.uint32)) for a, b in zip(cut.tolist(), ends, strict=True)]
                yield pa.record_batch([pa.array([*some.tolist(), -1], pa.int32()), pa.array([row["block"]] * (len(some) + 1)), pa.array([*data, table.astype(np.int64).tobytes()], pa.binary())], names=["bucket", "block", "data"])

    return count


def _add_tables(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("data").to_pylist():
            table = np.frombuffer(x, np.int64)
            total = table.copy() if total is None else total + table
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["data"])


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the training texts under their classes, but for what no class changes."""
    def xlogx(x: np.ndarray) -> float:
        x = x[x > 0].astype(float)
        return float((x * np.log(x)).sum())

    return xlogx(table.ravel()) - xlogx(table.sum(1)) - xlogx(table.sum(0))


def transitions(table: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed by the classes' shares."""
    share = table.sum(0) / max(1, table.sum())
    return (table + BIGRAM_PRIOR * share) / (table.sum(1, keepdims=True) + BIGRAM_PRIOR)


def best_classes(counts: np.ndarray, times: np.ndarray, cls: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word that makes the texts most likely under the table; counts: by class before,
    then by class after. A class without words, and class 0, takes none; ties leave a word, or go
    to the first class."""
    k = len(table)
    with np.errstate(divide="ignore"):
        p, size = np.log(transitions(table)), np.log(table.sum(0))
    usable = np.flatnonzero(np.isfinite(size) & (np.arange(k) > 0))
    # what has no share has no counts either
    p = np.where(np.isfinite(p), p, 0.0)
    value = counts[:, :k] @ p[:, usable] + counts[:, k:] @ p[usable].T - times[:, None] * size[usable]
    value = np.round(value, 6)
    best = usable[value.argmax(1)]
    own = np.searchsorted(usable, cls)
    stay = value[np.arange(len(cls)), np.minimum(own, len(usable) - 1)] >= value.max(1)
    return np.where(stay, cls, best)


def _exchange(table: np.ndarray):
    k = len(table)

    def exchange(key: tuple, counts: pa.Table, known: pa.Table) -> pa.Table:
        """A bucket's words, each in its best class."""
        words, place, cls = _held(known)
        times = w.column(words, "times")
        codes, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block, data in zip(counts.column("block").to_pylist(), counts.column("data").to_pylist(), strict=True):
            code, n = w.unpack_sorted(data)
            code = code.astype(np.int64)
            codes.append(place[block][code // (2 * k)].astype(np.int64) * 2 * k + code % (2 * k))
            many.append(n)
        code, n = np.concatenate(codes), np.concatenate(many)
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order].astype(float)
        out = cls.copy()
        for a in range(0, len(cls), ABREAST):
            b = min(len(cls), a + ABREAST)
            lo, hi = np.searchsorted(code, [a * 2 * k, b * 2 * k])
            dense = np.bincount(code[lo:hi] - a * 2 * k, n[lo:hi], (b - a) * 2 * k).reshape(b - a, 2 * k)
            seen = times[a:b] > 0
            out[a:b][seen] = best_classes(dense[seen], times[a:b][seen], cls[a:b][seen], table)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return exchange


def _begin(first: dict[int, list[tuple[int, int]]], rest: int):
    def begin(key: tuple, table: pa.Table) -> pa.Table:
        """A bucket's first classes: of the first words one each, of the rest one."""
        times = w.column(w.unpack(table.column("data")[0].as_py()), "times")
        cls = np.where(times > 0, rest, UNSEEN).astype(np.uint8)
        for place, c in first.get(key[0].as_py(), []):
            cls[place] = c
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([cls.tobytes()], pa.binary())})

    return begin


def _score(table: np.ndarray, n: int, v: int, once: int, n_texts: int):
    k = len(table)
    unseen = (once + 1) / (n + once + 2)
    share = (table.sum(0) + 1e-9) / (table.sum() + 1e-9 * k)
    p = np.vstack([transitions(table) if table.any() else np.tile(share, (k, 1)), share]) * (1 - unseen)
    with np.errstate(divide="ignore"):
        step = np.log10(np.hstack([p, np.full((k + 1, 1), unseen)]))
        size = np.log10(np.append(np.maximum(table.sum(0), 1), 1))
    norm = n + 0.1 * (v + 1)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for r, row in enumerate(_rows(batch.drop_columns(["ids"]))):
                doc, word, held = _sequence(row)
                cls = np.append(_told(row, "cls"), 0)
                times = np.append(_told(row, "times"), n_texts).astype(float)
                now, c = np.minimum(cls[word], k), times[word]
                before = np.zeros_like(now)
                before[1:] = now[:-1]
                own = np.where((now < k) & (c > 0), np.log10(np.maximum(c, 1)) - size[now], 0.0)
                m = len(held)
                out = [ids[r].values, pa.array(held), pa.array(np.bincount(doc, minlength=m)), pa.array(np.bincount(doc, c > 0, m).astype(np.int64)),
                       pa.array(np.bincount(doc, np.log10((c + 0.1) / norm), m)), pa.array(np.bincount(doc, step[before, now] + own, m))]
                yield pa.record_batch(out, names=list(columns))

    return score


class Classes:
    """The classes of all training words of docs(doc_id, text), and what scoring needs."""

    def __init__(self, docs: DataFrame, classes: int = CLASSES):
        if not 3 <= classes < UNSEEN:
            raise ValueError("from 3 to 254 classes")
        spark = docs.sparkSession
        n = parts(spark)
        named = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
        self.kind = dict(named.dtypes)["doc_id"]
        kind = pa.schema(named.limit(0).toArrow().schema).field("doc_id").type
        self.blocks = written(named.mapInArrow(_read(n, kind), _BLOCKS.format(self.kind)), "class-lm-blocks")
        asked = self.blocks.select("block", "words", "buckets").mapInArrow(_ask, "bucket int, block string, data binary")
        self.known = written(asked.groupBy("bucket").applyInArrow(_sum_words(classes), _KNOWN), "class-lm-words")
        total = self.known.where("kind = 0").agg(F.sum("times").alias("n"), F.sum("seen").alias("v"), F.sum("once").alias("once")).first()
        self.n_texts = named.where(~F.col("held_out")).count()
        # one more distinct token, and a token for each text: their ends
        self.n, self.v, self.once = (total.n or 0) + self.n_texts, (total.v or 0) + (self.n_texts > 0), total.once or 0
        best = self.known.where("kind = 2").orderBy(F.col("times").desc(), "block").limit(classes - 2).select("bucket", "seen").collect()
        first: dict[int, list[tuple[int, int]]] = {}
        for c, r in enumerate(best):
            first.setdefault(r.bucket, []).append((r.seen, c + 1))
        state = saved(self.known.where("kind = 0").groupBy("bucket").applyInArrow(_begin(first, classes - 1), "bucket int, data binary"))
        self.sweeps, self.likelihood, self.state, self.table = 0, -math.inf, state, np.zeros((classes, classes), np.int64)
        if not self.n_texts:
            return
        while True:
            counts = saved(self._beside(state, "cls").mapInArrow(_count(classes), _COUNTS))
            table = self._sum(counts, classes)
            found = likelihood(table)
            gain = found - self.likelihood
            if gain > 0:
                self.likelihood, self.state, self.table = found, state, table
            if gain < GAIN * self.n:
                break
            self.sweeps += 1
            state = saved(counts.where("bucket >= 0").groupBy("bucket").cogroup(self._with(state).groupBy("bucket")).applyInArrow(_exchange(table), "bucket int, data binary"))

    def _with(self, state: DataFrame) -> DataFrame:
        """What the buckets know, with their words' classes."""
        have = self.known.where("kind < 2").select("kind", "bucket", "block", "data")
        return have.union(state.select(F.lit(3).alias("kind"), "bucket", F.lit(None).cast("string").alias("block"), "data"))

    def _beside(self, state: DataFrame, *what: str) -> DataFrame:
        """The blocks, each told its words' classes (or counts too)."""
        told = self._with(state).groupBy("bucket").applyInArrow(_tell, "block string, bucket int, cls binary, times binary").select("block", "bucket", *what)
        told = saved(told.groupBy("block").agg(F.collect_list(F.struct("bucket", *what)).alias("told")))
        size = told.agg(F.sum(F.aggregate("told", F.lit(0).cast("bigint"), lambda a, x: a + sum((F.octet_length(x[c]) for c in what), F.lit(8))))).first()[0] or 0
        told = F.broadcast(told) if size <= TOLD else told
        # a block without words has asked nothing
        out = self.blocks.join(told, "block", "left")
        return out.withColumn("told", F.coalesce("told", F.array().cast(told.schema["told"].dataType)))

    @staticmethod
    def _sum(counts: DataFrame, classes: int) -> np.ndarray:
        some = counts.where("bucket = -1").select("data", F.pmod(F.xxhash64("block"), F.lit(64)).alias("part"))
        some = some.groupBy("part").applyInArrow(_add_tables, "data binary").withColumn("part", F.lit(0))
        return np.frombuffer(some.groupBy("part").applyInArrow(_add_tables, "data binary").first().data, np.int64).reshape(classes, classes)

    def words(self) -> DataFrame:
        """word, times, class: every training word."""
        def listed(key: tuple, table: pa.Table) -> pa.Table:
            words, _, cls = _held(table)
            times = w.column(words, "times")
            seen = pa.array(times > 0)
            return pa.table({"word": words.column("word").cast(pa.string()), "times": pa.array(times, pa.int64()), "class": pa.array(cls, pa.int32())}).filter(seen)

        return self._with(self.state).where("kind <> 1").groupBy("bucket").applyInArrow(listed, "word string, times long, class int")

    def scores(self) -> DataFrame:
        scored = self._beside(self.state, "cls", "times").select("ids", "held", "sizes", "tokens", "buckets", "told").mapInArrow(
            _score(self.table, self.n, self.v, self.once, self.n_texts), f"doc_id {self.kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.n).cast("bigint").alias("train_tokens"), "base_score", "score", F.lit(self.sweeps).alias("sweeps"))


def score_texts(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, sweeps."""
    return Classes(docs, classes).scores()
