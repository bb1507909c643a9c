"""Word and shingle arithmetic over Arrow string buffers, in numpy.

A text is seen as UTF-8 bytes. A 256-entry table says which bytes belong to words and which byte
each one counts as, so one pass finds word bounds without making Python strings. Word hashes are
64-bit polynomials of the word's bytes, mixed; sequence hashes are polynomials of word hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_Q = U64(0xD6E8FEB86659FD93)
#: Bytes whose prefix sums are held at once.
_SLICE = 1 << 19

_IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = _IDENTITY.copy()
LOWER[65:91] += 32

#: Bytes of `[^\\x20\\x09-\\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(p: np.uint64) -> np.uint64:
    return U64(pow(int(p), -1, 1 << 64))


_POW: dict[int, np.ndarray] = {}


def powers(p: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(p))
    if have is None or len(have) < n:
        have = _POW[int(p)] = _powers(p, max(n, _SLICE + 1))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def compact(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as an array of its own, not a slice of another (which some Arrow kernels
    read wrongly); null becomes empty."""
    data, offsets = buffers(col)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))


@dataclass
class Words:
    """Words of some texts: byte bounds, and for text d the words first[d]..first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, p: np.uint64 = _P) -> np.ndarray:
        """A 64-bit hash of each word's bytes. Prefix sums cover a bounded slice at a time."""
        out = np.empty(len(self.start), U64)
        inv, at = _inverse(p), 0
        while at < len(out):
            base = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, base + _SLICE, "right")))
            s, e = self.start[at:stop] - base, self.end[at:stop] - base
            n = int(e[-1])
            sums = np.zeros(n + 1, U64)
            np.cumsum((self.data[base:base + n].astype(U64) + U64(1)) * powers(p, n), out=sums[1:])
            out[at:stop] = (sums[e] - sums[s]) * powers(inv, n + 1)[s]
            at = stop
        return mix(out + (self.end - self.start).astype(U64))


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray,
               as_byte: np.ndarray = _IDENTITY) -> Words:
    """Maximal runs of word bytes; a run never crosses from one text into the next."""
    data = as_byte[data] if as_byte is not _IDENTITY else data
    inside = is_word[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    before[bounds] = False
    after[bounds - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i:i + k] for each i."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m].copy()
    for j in range(1, k):
        out *= _Q
        out += h[j:j + m]
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """min(x[i:i + k]) for each i, in log2(k) passes."""
    have = 1
    while have < k:
        step = min(have, k - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def starts_within(first: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one text follow; first: as in Words."""
    n = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(room >= k)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] values, then the same for start[1], ..."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    skip = np.repeat(np.cumsum(length) - length, length)
    return np.repeat(np.asarray(start, np.int64), length) + np.arange(total) - skip


def pack(**columns: np.ndarray | pa.Array) -> bytes:
    """Columns of one length as one compressed blob."""
    batch = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


def pack_sorted(keys: np.ndarray, many: np.ndarray) -> bytes:
    """Ascending keys with a number each. The keys go as gaps, byte by byte: the upper bytes of small
    gaps are all zero and pack to nothing."""
    gaps = np.diff(keys.astype(U64, copy=False), prepend=U64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return pack(many=many, **{f"b{k}": planes[k] for k in range(8)})


def unpack_sorted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    have = unpack(blob)
    planes = np.stack([column(have, f"b{k}") for k in range(8)], 1)
    return np.cumsum(np.ascontiguousarray(planes).view(U64).ravel()), column(have, "many")


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def pieces(col: pa.Array | pa.ChunkedArray, limit: int = 4 << 20):
    """Consecutive slices of a string column, of about ``limit`` bytes or one longer text each."""
    offsets = buffers(col)[1]
    at = 0
    while at < len(col):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield col.slice(at, stop - at)
        at = stop
