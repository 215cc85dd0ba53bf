"""Word and shingle hashes of whole Arrow text columns, many texts at a time.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Words are hashed from prefix sums
of a polynomial over the bytes, so no Python object is made for a word. Texts are taken in
slices of about ``SLICE`` bytes: memory follows the longest text, never the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SHINGLE = 5
_ONE = 2**64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, _ONE)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_STEPS = mix(np.arange(901, 901 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 2 * SLICE)
        known = np.empty(size, dtype=np.uint64)
        known[0] = 1
        known[1:] = base
        np.multiply.accumulate(known, out=known)
        if size <= 2 * SLICE:  # longer ones serve one text only
            _powers[base] = known
    return known


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column, null as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs.astype(np.int64)


class Words:
    """Hashed words of some texts: ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
        self.n = len(offsets) - 1
        base = offsets[0]
        data = data[base : offsets[-1]]
        at = offsets - base
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True  # a text's end parts words even without a space
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, at)
        if lower:
            data = _LOWER[data]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * _powers_of(_BASE, len(data) + 1)[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.begin]) * _powers_of(_INVERSE, len(data) + 1)[self.begin])

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``SHINGLE`` words in a row and where each text's begin; shorter texts give all their words as one."""
        k, n = SHINGLE, len(self.hash)
        counts = np.diff(self.first)
        many = np.maximum(counts - k + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(many)])
        full = max(n - k + 1, 0)
        run = np.zeros(full, dtype=np.uint64)
        for j in range(k):
            run += self.hash[j : j + full] * _STEPS[j]
        run = mix(run)
        out = np.empty(first[-1], dtype=np.uint64)
        long = counts >= k
        at = np.repeat(self.first[:-1][long] - first[:-1][long], many[long]) + _places(first, long)
        out[_places(first, long)] = run[at]
        for i in np.flatnonzero((counts > 0) & ~long):
            own = self.hash[self.first[i] : self.first[i + 1]]
            out[first[i]] = mix(np.array([(own * _STEPS[: len(own)]).sum(dtype=np.uint64) ^ np.uint64(len(own))]))[0]
        return out, first


def _places(first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """All places of the chosen texts, in order."""
    flags = np.zeros(first[-1] + 1, dtype=np.int8)
    many = np.diff(first)
    keep = chosen & (many > 0)
    np.add.at(flags, first[:-1][keep], 1)
    np.add.at(flags, first[1:][keep], -1)
    return np.flatnonzero(np.cumsum(flags)[:-1])


def sliced_bytes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """Words of some texts, a slice of texts at a time, with the place of the slice's first text."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, Words(data, offsets[row : stop + 1], lower, space)
        row = stop


def sliced(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, Words]]:
    """Words of a column, a slice of rows at a time, with the place of the slice's first row."""
    yield from sliced_bytes(*buffers(column), lower=lower)


def each_text(column: pa.Array, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and word hashes of each text of a column, hashed a slice of rows at a time."""
    for _, words in sliced(column, lower):
        hashes, first = words.shingles()
        for a, b, c, d in zip(first[:-1].tolist(), first[1:].tolist(), words.first[:-1].tolist(), words.first[1:].tolist()):
            yield hashes[a:b], words.hash[c:d]


def list_fields(column: pa.Array, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The named fields of each row of a column of lists of structs (null: no entries), as arrays."""
    bounds = column.offsets.to_numpy().tolist()
    fields = [column.values.field(n).to_numpy(zero_copy_only=False) for n in names]
    for a, b, there in zip(bounds[:-1], bounds[1:], column.is_valid().to_pylist()):
        yield tuple(f[a:b] if there else f[:0] for f in fields)


def in_blocks(rows: Iterator[list[np.ndarray]], names: list[str], size: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Columns of few rows each, put together to batches of ``size`` rows or a few more."""
    held, n = [], 0
    for columns in rows:
        held.append(columns)
        n += len(columns[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
