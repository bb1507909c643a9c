"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into strips of ``STRIP`` bytes. A forward and a backward gated
recurrent layer run over each strip, and a softmax labels every byte position with a language
distribution. The whole text's distribution is the mean over all its positions of the log
probabilities, normalised again; no byte is left out.

The network is trained by backpropagation through time on a bounded sample: for each language of
the training rows, however many there are, about ``SAMPLE_DOCS`` documents, at least one, chosen
by hash, and of each about ``SAMPLE_STRIPS`` strips, drawn by hash from the whole text. The output
layer grows with the languages, the steps too, up to ``MOST_TURNS`` times those of ``STEP_LANGS``
languages; beyond, each language has fewer turns. The weights (a few thousand numbers) travel in the
function; texts are scored where they lie, without a shuffle. Training starts from a fixed seed on a
sample in fixed order, so reruns agree. Very long texts are scored whole, in slices of bounded size.

Prediction sees the text alone. A null text, or one without a letter, gets ``und`` and score 0;
so does everything if nothing can be learned. Repeated rows get equal predictions; extra columns
are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w

UNKNOWN = "und"
HIDDEN = 8
STRIP = 48
SAMPLE_DOCS = 300
#: Strips that training sees of one sampled text, drawn from all of it.
SAMPLE_STRIPS = 20
#: Languages that share a training step; more of them take as many more steps.
STEP_LANGS = 64
#: Languages whose bars are broadcast, some 50 bytes each; beyond, they are joined by language.
BROADCAST_LANGS = 100_000
#: Times the steps of STEP_LANGS languages that training takes at most, however many there are.
MOST_TURNS = 8
#: Strips that go through the network together; keeps a step's arrays in a core's cache.
ABREAST = 2048
TRAINING_SHARE = 5

_RESULT = "struct<lang: string, score: double>"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])
_LETTER = regex.compile(r"\p{L}")
_PADDING = 0


def held_out(doc_id: Column) -> Column:
    """True for documents that training never sees: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(TRAINING_SHARE)) == 0, F.lit(True))


def _tanh(x: np.ndarray) -> np.ndarray:
    return np.tanh(x, out=x)


@dataclass
class ByteGru:
    """The network. Both directions share one state of 2 * HIDDEN numbers; gates come as (update,
    reset, candidate), each for both directions, and a recurrent weight from one direction to the
    other is always 0."""

    langs: list[str]
    embed: np.ndarray  # (2, 256, 3, h): the gates' input for each direction and byte
    gates: np.ndarray  # (2h, 4h): state to update and reset
    cand: np.ndarray  # (2h, 2h): reset state to candidate
    out: np.ndarray  # (2h, langs)
    bias: np.ndarray

    @staticmethod
    def mask(h: int) -> np.ndarray:
        return np.kron(np.eye(2), np.ones((h, h))).astype(np.float32)

    @classmethod
    def fresh(cls, langs: list[str], h: int = HIDDEN, seed: int = 11) -> ByteGru:
        rng = np.random.default_rng(seed)
        m = cls.mask(h)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        embed = draw(2, 256, 3, h, scale=0.5)
        embed[:, :, 0] -= 1.0  # a slow state at first, so that errors reach back
        square = [draw(2 * h, 2 * h, scale=h ** -0.5) * m for _ in range(3)]
        return cls(langs, embed, np.concatenate(square[:2], 1), square[2], draw(2 * h, len(langs), scale=0.3), np.zeros(len(langs), np.float32))

    def run(self, strips: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Both layers' states at every position: (length, strips, 2h). strips: (length, strips)."""
        length, n = strips.shape
        h = self.embed.shape[-1]
        state = np.zeros((n, 2 * h), np.float32)
        states = np.empty((length, n, 2 * h), np.float32)
        half = np.float32(0.5)
        wide = np.empty((n, 3, 2, h), np.float32)
        for t in range(length):
            wide[:, :, 0] = self.embed[0][strips[t]]
            wide[:, :, 1] = self.embed[1][strips[length - 1 - t]]
            inputs = wide.reshape(n, 6 * h)
            zr = state @ self.gates
            zr += inputs[:, :4 * h]
            zr *= half
            _tanh(zr)
            zr *= half
            zr += half
            z, r = zr[:, :2 * h], zr[:, 2 * h:]
            c = (r * state) @ self.cand
            c += inputs[:, 4 * h:]
            _tanh(c)
            if keep is not None:
                keep.append((state, z, r, c))
            state = state + z * (c - state)
            states[t, :, :h] = state[:, :h]
            states[length - 1 - t, :, h:] = state[:, h:]
        return states

    def log_probabilities(self, states: np.ndarray) -> np.ndarray:
        y = states @ self.out + self.bias
        y -= y.max(-1, keepdims=True)
        return y - np.log(np.exp(y).sum(-1, keepdims=True))

    def gradients(self, strips: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        length, n = strips.shape
        h = self.embed.shape[-1]
        kept: list = []
        states = self.run(strips, kept)
        logp = self.log_probabilities(states)
        real = (strips != _PADDING).astype(np.float32)[:, :, None] / max(1, int((strips != _PADDING).sum()))
        hot = np.eye(len(self.langs), dtype=np.float32)[label][None]
        loss = float(-(logp * hot * real).sum())
        dy = (np.exp(logp) - hot) * real
        flat = dy.reshape(-1, dy.shape[-1])
        g = {"out": states.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(0)}
        ds = dy @ self.out.T
        g_gates, g_cand, g_embed = np.zeros_like(self.gates), np.zeros_like(self.cand), np.zeros((512, 3, h), np.float32)
        down = np.zeros((n, 2 * h), np.float32)
        for t in reversed(range(length)):
            before, z, r, c = kept[t]
            down[:, :h] += ds[t, :, :h]
            down[:, h:] += ds[length - 1 - t, :, h:]
            dc = down * z * (1 - c * c)
            back = dc @ self.cand.T
            dzr = np.concatenate([down * (c - before) * z * (1 - z), back * before * r * (1 - r)], 1)
            g_cand += (r * before).T @ dc
            g_gates += before.T @ dzr
            inputs = np.concatenate([dzr, dc], 1).reshape(n, 3, 2, h)
            for side, at in ((0, strips[t].astype(np.int64)), (1, strips[length - 1 - t].astype(np.int64) + 256)):
                np.add.at(g_embed, at, inputs[:, :, side])
            down = down * (1 - z) + back * r + dzr @ self.gates.T
        m = self.mask(h)
        g |= {"gates": g_gates * np.concatenate([m, m], 1), "cand": g_cand * m, "embed": g_embed.reshape(2, 256, 3, h)}
        return loss, g

    def fit(self, strips: np.ndarray, label: np.ndarray, steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 5) -> ByteGru:
        """Adam over random batches, the rate falling to 0."""
        rng = np.random.default_rng(seed)
        names = ("embed", "gates", "cand", "out", "bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        by_label = [np.flatnonzero(label == k) for k in range(len(self.langs))]
        steps = min(MOST_TURNS * steps, -(-steps * max(len(by_label), STEP_LANGS) // STEP_LANGS))
        for step in range(1, steps + 1):
            turn = by_label if len(by_label) <= STEP_LANGS else [by_label[k] for k in rng.choice(len(by_label), STEP_LANGS, replace=False)]
            pick = np.concatenate([rng.choice(x, max(1, batch // len(turn))) for x in turn if len(x)])
            _, grads = self.gradients(np.ascontiguousarray(strips[:, pick]), label[pick])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k in names:
                g = grads[k] * np.float32(min(1.0, 1.0 / (size + 1e-9)))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                getattr(self, k)[...] -= np.float32(rate * (1 - step / (steps + 1))) * move.astype(np.float32)
        return self

    def label_positions(self, text: str) -> np.ndarray:
        """Log probabilities of the languages at each byte of a text: (bytes, langs)."""
        raw = text.encode()
        strips = np.frombuffer(raw.ljust(-(-len(raw) // STRIP) * STRIP, b"\0"), np.uint8).reshape(-1, STRIP).T
        return self.log_probabilities(self.run(strips)).transpose(1, 0, 2).reshape(-1, len(self.langs))[:len(raw)]

    def state_sums(self, strips: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """The sum of ``run``'s states over each strip's (real) positions: (strips, 2h).

        The same steps with the two directions side by side, in place and without the states kept.
        """
        length, n = strips.shape
        h = self.embed.shape[-1]
        tables = self.embed.reshape(2, 256, 3 * h).copy()
        tables[:, :, :2 * h] *= 0.5
        gates = np.stack([np.concatenate([self.gates[s, :2 * h][:, s], self.gates[s, 2 * h:][:, s]], 1) for s in (slice(0, h), slice(h, 2 * h))]) * np.float32(0.5)
        cand = np.stack([self.cand[:h, :h], self.cand[h:, h:]])
        state, total = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        x, zr, c = np.empty((2, n, 3 * h), np.float32), np.empty((2, n, 2 * h), np.float32), np.empty((2, n, h), np.float32)
        for t in range(length):
            for side, at in ((0, t), (1, length - 1 - t)):
                np.take(tables[side], strips[at], axis=0, out=x[side], mode="clip")
            np.matmul(state, gates, out=zr)
            zr += x[:, :, :2 * h]
            np.tanh(zr, out=zr)
            zr += 1  # twice the gate
            np.multiply(zr[:, :, h:], state, out=c)
            c *= 0.5
            np.matmul(c, cand, out=x[:, :, :h])
            np.add(x[:, :, :h], x[:, :, 2 * h:], out=c)
            np.tanh(c, out=c)
            c -= state
            c *= zr[:, :, :h]
            c *= 0.5
            state += c
            if real is None:
                total += state
            else:
                total[0] += state[0] * real[t][:, None]
                total[1] += state[1] * real[length - 1 - t][:, None]
        return np.concatenate([total[0], total[1]], 1)

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """Language probabilities of each text: (texts, langs); uniform for an empty text.

        A position's log probabilities are its logits less one number that all languages share, so
        their mean over the positions is the logits of the mean state, up to that number.
        """
        data, offsets = w.buffers(texts)
        size = np.diff(offsets)
        sums = np.zeros((len(texts), self.out.shape[0]))
        count = size // STRIP
        owner = np.repeat(np.arange(len(texts)), count)
        start = offsets[:-1][owner] + STRIP * w.ranges(np.zeros(len(size), np.int64), count)
        rest = np.flatnonzero(size % STRIP)
        rest_start = offsets[:-1][rest] + STRIP * count[rest]
        padded = np.concatenate([data, np.zeros(STRIP, np.uint8)])
        steps = np.arange(STRIP)[:, None]
        for whole, starts, who in ((True, start, owner), (False, rest_start, rest)):
            for at in range(0, len(starts), ABREAST):
                s, d = starts[at:at + ABREAST], who[at:at + ABREAST]
                strips = padded[s[None, :] + steps].astype(np.intp)
                real = None
                if not whole:
                    inside = steps < (size % STRIP)[d][None, :]
                    strips, real = np.where(inside, strips, _PADDING), inside.astype(np.float32)
                got = self.state_sums(strips, real)
                for k in range(sums.shape[1]):
                    sums[:, k] += np.bincount(d, got[:, k], len(texts))
        mean = (sums / np.maximum(size, 1)[:, None]) @ self.out.astype(float) + self.bias
        p = np.exp(mean - mean.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _drawn_strips(text: Column) -> Column:
    """SAMPLE_STRIPS strips of a text's bytes, drawn by a hash from all its strips; all if it has no
    more."""
    raw = F.encode(text, "UTF-8")
    n = F.ceil(F.octet_length(text) / STRIP).cast("int")
    # one strip of each of SAMPLE_STRIPS equal shares, so none is drawn twice
    first = lambda k: F.floor(k.cast("bigint") * n / SAMPLE_STRIPS).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_STRIPS - 1)), lambda k: first(k) + F.pmod(F.xxhash64(text, k), (first(k + 1) - first(k)).cast("bigint")).cast("int"))
    at = F.when(n > SAMPLE_STRIPS, drawn).otherwise(F.sequence(F.lit(0), n - 1))
    return F.transform(at, lambda k: F.substring(raw, k * STRIP + 1, STRIP))


def _strips(strips: list[list[bytes]], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All strips of the sampled texts, a text's last one padded."""
    cut = [(bytes(x).ljust(STRIP, b"\0"), k) for own, k in zip(strips, labels, strict=True) for x in own]
    if not cut:
        return np.zeros((STRIP, 0), np.uint8), np.zeros(0, np.int64)
    return np.stack([np.frombuffer(x, np.uint8) for x, _ in cut], 1), np.array([k for _, k in cut])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, hidden: int = HIDDEN, steps: int = 240) -> ByteGru | None:
    """Learn from docs(doc_id, text, lang): rows that are not held out and have a lang and a text."""
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not counts:
        return None
    # below its bar a language has about sample_docs rows, and its least draw
    bars = [(r.lang, max(r.least + 1, math.ceil(min(1.0, sample_docs / r.n) * (1 << 30)))) for r in counts]
    bars = docs.sparkSession.createDataFrame(bars, "lang string, bar long")
    bars = F.broadcast(bars) if len(counts) <= BROADCAST_LANGS else bars
    drawn = usable.join(bars, "lang").where(draw < F.col("bar"))
    # rows that repeat draw alike, and count once
    rows = drawn.select(F.xxhash64("doc_id", "text").alias("at"), _drawn_strips(F.col("text")).alias("strips"), "lang").distinct().collect()
    rows.sort(key=lambda r: (r.at, [bytes(x) for x in r.strips], r.lang))
    langs = sorted({r.lang for r in rows})
    place = {x: k for k, x in enumerate(langs)}
    strips, label = _strips([r.strips for r in rows], [place[r.lang] for r in rows])
    return ByteGru.fresh(langs, hidden).fit(strips, label, steps)


def _predictor(net: ByteGru | None):
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [pa.array([], _ARROW)]
            for piece in w.pieces(batch):
                texts = piece.to_pylist()
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if net is not None:
                    pooled = net.pooled(piece)
                    best = pooled.argmax(1)
                    for i, t in enumerate(texts):
                        if t and _LETTER.search(t):
                            lang[i], score[i] = net.langs[best[i]], float(pooled[i, best[i]])
                done.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], fields=list(_ARROW)))
            yield pa.concat_arrays(done)

    return F.arrow_udf(predict, _RESULT).asNondeterministic()


def identify(docs: DataFrame, result: str, net: ByteGru | None) -> DataFrame:
    """docs with a struct column ``result`` of lang and score."""
    return docs.withColumn(result, _predictor(net)("text"))


def languages(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    net = train(docs)
    found = identify(docs.select("doc_id", "text"), "found", net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose language can be told: those predicted ``und`` go, the rest stays unchanged."""
    name = "found"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return identify(docs, name, train(docs)).where(F.col(name)["lang"] != UNKNOWN).drop(name)
