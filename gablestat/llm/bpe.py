"""Byte-level BPE as a monoid over pieces of text, encoded and decoded by tree reduction.

An ``Encoded`` element holds the ids of a piece of text and the text at both of its ends. Two neighbours are
joined by encoding the text around their border anew. The window grows from the border to the nearest *cut* on
either side, a place where a visible character is followed by white space. The pattern starts a match at every
cut, whatever stands around it, so ids beyond the window can't change: ``join`` is associative and the
ids of a text don't depend on where it was halved. A text without any cut is simply encoded anew.

Texts of at most ``SEGMENT`` characters are halved inside one task. Longer ones are cut into rows, encoded in any
number of tasks and joined level by level, two rows to a group.

Defined results: a null text counts as empty, an empty text has no ids and decodes to no bytes; rows may repeat
and doc_id may be null or repeat; a text of one endless word is right, only slower; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestat.llm.words import buffers, sliced_bytes
from gablestat.session import cut_lineage

#: Characters of a row of a long text, and of a text that is not halved any more.
SEGMENT, LEAF = 1 << 16, 1 << 12
#: Bytes of text whose pieces between spaces are encoded once by ``bulk``.
BULK = 16 << 20
#: Bytes of ids or text in one Arrow batch that a task returns, beyond the first row.
BATCH = 4 << 20
_CUT = re.compile(r"[!-~\w](?=[ \t\n\r])")
#: ASCII white space, and first bytes of the other white space in UTF-8 (and of some letters and signs).
_SPACE_FIRST = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xC2, 0xE1, 0xE2, 0xE3])
_SPACE_LAST = (np.arange(256) >= 0x80) | np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
_BLANK = np.arange(256) == 0x20


class Encoded(NamedTuple):
    """``ids`` as little-endian 32-bit bytes; ``head`` and ``tail`` reach to the nearest cut; without a cut both are the whole text."""

    ids: bytes
    head: str
    tail: str
    cut: bool


class Encoder:
    """A ``.tiktoken`` vocabulary with its pattern; ``special`` maps strings to ids, none by default."""

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.special = dict(special)
        self.coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.table = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, rank in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.table[rank] = token
        self.spaced = np.array([t.startswith(b" ") for t in self.table])

    def leaf(self, text: str) -> bytes:
        """Ids of a short text."""
        return array("I", self.coding.encode_ordinary(text)).tobytes()

    def whole(self, text: str) -> list[int]:
        """Ids of a text, special strings as their own ids."""
        return self.coding.encode(text, allowed_special="all") if self.special else self.coding.encode_ordinary(text)

    def element(self, text: str) -> Encoded:
        """The text's element, by halves."""
        if len(text) > LEAF:
            half = len(text) // 2
            return self.join(self.element(text[:half]), self.element(text[half:]))
        first = _CUT.search(text)
        if first is None:
            return Encoded(self.leaf(text), text, text, False)
        return Encoded(self.leaf(text), text[: first.end()], text[_last_cut(text) :], True)

    def join(self, a: Encoded, b: Encoded) -> Encoded:
        """The element of both texts in a row."""
        left, right = a.tail, b.head
        border = bool(left and right and _CUT.match(left[-1] + right[0]))
        if border:
            ids = a.ids + b.ids
        else:
            ids = a.ids[: len(a.ids) - len(self.leaf(left))] + self.leaf(left + right) + b.ids[len(self.leaf(right)) :]
        if not (a.cut or b.cut or border):
            return Encoded(ids, left + right, left + right, False)
        head = a.head if a.cut else left if border else left + right
        tail = b.tail if b.cut else right if border else left + right
        return Encoded(ids, head, tail, True)

    def encode(self, text: str) -> bytes:
        return self.element(text).ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, halves put together."""
        if len(ids) > LEAF:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def _last_cut(text: str) -> int:
    """The place of the last cut; there is one."""
    size = 64
    while True:
        start = max(0, len(text) - size)
        found = [m.end() for m in _CUT.finditer(text, start)]
        if found:
            return found[-1]
        size *= 4


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Encoder:
    """One encoder for each vocabulary in a Python process."""
    if (path, pattern, special) not in _encoders:
        _encoders[path, pattern, special] = Encoder(path, pattern, special)
    return _encoders[path, pattern, special]


def bulk(column: pa.Array, own: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids of a text column, about ``BULK`` bytes at a time: first row's place, all ids, and where each row's begin.

    Between two spaces most texts hold the same few pieces, so every distinct piece of the bytes at hand is encoded once,
    all of them as one string, and rows are put together from them. A match starts at every space except inside or at the
    end of a longer run of white space; a text with such a run, or a special string, is encoded as a whole.
    """
    data, offsets = buffers(column)
    row = 0
    while row < len(column):
        stop = min(len(column), max(row + 1, int(np.searchsorted(offsets, offsets[row] + BULK, side="right")) - 1))
        yield row, *_bulk(data, offsets[row : stop + 1], own)
        row = stop


def _bulk(data: np.ndarray, offsets: np.ndarray, own: Encoder) -> tuple[np.ndarray, np.ndarray]:
    n, base = len(offsets) - 1, offsets[0]
    raw = data[base : offsets[-1]]
    text, ends = raw.tobytes(), offsets - base
    blank = np.flatnonzero(raw == 0x20)
    last = np.isin(blank + 1, ends)
    after = np.append(raw, 0x20)[blank + 1]
    odd = blank[last | (after == 0x20) | (_SPACE_FIRST[after] & _SPACE_LAST[raw[blank - 1]])]
    aside = np.zeros(n, dtype=bool)
    aside[np.searchsorted(ends, odd, side="right") - 1] = True
    for word in own.special:
        at = text.find(word.encode())
        while at >= 0:
            aside[np.searchsorted(ends, at, side="right") - 1] = True
            at = text.find(word.encode(), at + 1)
    hashes, begins, finishes, firsts = [], [], [], [np.zeros(1, np.int64)]
    for at, words in sliced_bytes(raw, ends, _BLANK):
        hashes.append(words.hash)
        begins.append(words.begin + ends[at])
        finishes.append(words.end + ends[at])
        firsts.append(words.first[1:] + firsts[-1][-1])
    hashes, begins, finishes, first = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, begins, finishes, firsts))
    entry, distinct = pd.factorize(hashes)
    example = np.empty(len(distinct), dtype=np.int64)
    example[entry[::-1]] = np.arange(len(entry))[::-1]
    plain = ~_SPACE_FIRST[raw[begins[example]]] if len(example) else np.zeros(0, bool)
    lists: list[np.ndarray] = []
    table = np.zeros((2, len(example)), dtype=np.int64)  # of each distinct piece: first id, number of ids
    at = 0
    if plain.any():
        chosen = example[plain]
        sizes = finishes[chosen] - begins[chosen] + 1
        where = np.cumsum(sizes) - sizes
        joined = raw[np.repeat(begins[chosen] - 1 - where, sizes) + np.arange(sizes.sum())]
        joined[where] = 0x20
        ids = np.array(own.coding.encode_ordinary(joined.tobytes().decode()), dtype=np.uint32)
        starts = np.flatnonzero(own.spaced[ids])
        table[:, plain] = starts, np.diff(starts, append=len(ids))
        lists.append(ids)
        at = len(ids)
    for i in np.flatnonzero(~plain).tolist():
        ids = own.coding.encode_ordinary(" " + text[begins[example[i]] : finishes[example[i]]].decode())
        table[:, i] = at, len(ids)
        lists.append(np.array(ids, dtype=np.uint32))
        at += len(ids)
    # what starts a text without a space before it, and texts that are encoded as a whole, are entries of their own
    extra: list[tuple[int, int]] = []
    keep = np.ones(len(entry), dtype=bool)
    opening = (np.diff(first) > 0) & ~aside
    opening[opening] = begins[first[:-1][opening]] == ends[:-1][opening]
    for i in np.flatnonzero(opening | aside).tolist():
        if aside[i]:
            ids = own.whole(text[ends[i] : ends[i + 1]].decode())
            keep[first[i] + 1 : first[i + 1]] = False
        else:
            ids = own.coding.encode_ordinary(text[begins[first[i]] : finishes[first[i]]].decode())
        if first[i] < first[i + 1]:
            entry[first[i]] = len(example) + len(extra)
            extra.append((at, len(ids)))
            lists.append(np.array(ids, dtype=np.uint32))
            at += len(ids)
    table = np.concatenate([table, np.array(extra, dtype=np.int64).reshape(-1, 2).T], axis=1)
    sizes = np.where(keep, table[1][entry], 0)
    where = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
    out = flat[np.repeat(table[0][entry] - where[:-1], sizes) + np.arange(where[-1])]
    offs = where[first]
    for i in np.flatnonzero(aside & (np.diff(first) == 0)).tolist():  # nothing but spaces
        ids = np.array(own.whole(text[ends[i] : ends[i + 1]].decode()), dtype=np.uint32)
        out = np.insert(out, offs[i], ids)
        offs[i + 1 :] += len(ids)
    return out, offs


def id_lists(ids: list[bytes]) -> pa.Array:
    """Rows of ids as lists of int."""
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def text_parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Rows of a text column as strings, null as empty, about ``BATCH`` bytes at a time, with the first row's place."""
    column = column.fill_null("") if column.null_count else column
    sizes = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + BATCH, side="right")))
        yield row, column.slice(row, stop - row).to_pylist()
        row = stop


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for row, texts in text_parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), id_lists([own.encode(x) for x in texts])], names=[key, "ids"])

    out = rows.where(F.length("_text") <= segment).mapInArrow(short, f"`{key}` {kind}, ids array<int>")
    long = rows.where(F.length("_text") > segment)
    parts = cut_lineage(_segments(long.withColumn("_row", F.monotonically_increasing_id()), key, kind, segment))
    most = parts.agg(F.max("n")).first()[0]
    if most is None:
        return out
    fields = f"_row long, `{key}` {kind}, i long, n long, ids binary, head string, tail string, cut boolean"

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for frame in frames:
            done = pd.DataFrame([own.element(x) for x in frame["part"]], columns=Encoded._fields)
            yield pd.concat([frame[["_row", key, "i", "n"]].reset_index(drop=True), done], axis=1)

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        own = encoder(path, pattern)
        frame = frame.sort_values("i")
        both = [Encoded(bytes(r.ids), r.head, r.tail, r.cut) for r in frame.itertuples()]
        one = frame.iloc[:1].copy()
        joined = both[0] if len(both) == 1 else own.join(*both)
        one["i"], one["n"] = one["i"] // 2, (one["n"] + 1) // 2
        for name, value in joined._asdict().items():
            one[name] = [value]
        return one

    level = parts.repartition("_row", "i").mapInPandas(leaves, fields)
    while most > 1:
        level = level.groupBy("_row", F.floor(F.col("i") / 2).alias("_pair")).applyInPandas(pair, fields)
        most = (most + 1) // 2

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), id_lists([batch.column(1)[row].as_py()])], names=[key, "ids"])

    return out.unionByName(level.select(key, "ids").mapInArrow(lists, f"`{key}` {kind}, ids array<int>"))


def _segments(long: DataFrame, key: str, kind: str, segment: int) -> DataFrame:
    """Long texts as rows of ``segment`` characters: ``_row key i n part``."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, own, text in zip(frame["_row"], frame[key], frame["_text"]):
                parts = [text[i : i + segment] for i in range(0, len(text), segment)]
                yield pd.DataFrame({"_row": row, key: pd.Series([own] * len(parts), dtype=frame[key].dtype), "i": range(len(parts)), "n": len(parts), "part": parts})

    return long.select("_row", key, "_text").mapInPandas(cut, f"_row long, `{key}` {kind}, i long, n long, part string")


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded`` (binary), the bytes that their ids stand for; null ids give no bytes."""
    kept = [c for c in rows.columns if c != "decoded"]
    place = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            lists = batch.column(place)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(ends, ends[row] + BATCH // 4, side="right")) - 1)
                stop = min(stop, batch.num_rows)
                done = [own.decode(flat[ends[i] : ends[i + 1]]) for i in range(row, stop)]
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], names=[*kept, "decoded"])
                row = stop

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", decoded binary"
    return rows.select(*kept).mapInArrow(run, schema)
