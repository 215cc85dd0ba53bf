"""Best-fit packing of token pieces into sequences under several capacities at once.

Without ``limits`` only the tokens of a sequence bind, and packing is best-fit decreasing on them.

What a piece takes of each capacity (tokens, one document, length squared of attention) follows from its length, so
packing needs only how many pieces have each length: at most ``capacity`` counts, however large the corpus. ``plan``
packs these counts, longest first. For each length it takes the bin that scores best under every constraint, by the weighted
dot product of what the piece needs and the bin has left or by the weighted norm of what would be left, and fills all
equal bins in one step. A bin of the plan thus stands for many alike. ``pack`` then numbers the pieces of each length and
looks up their slots, where rank ``r`` of a length falls in one slot of one bin.

Bounds: every step uses up the pieces of a length or a kind of bin, a length adds at most three kinds, and a sequence holds
at most ``sqrt(2 * capacity)`` different lengths; the plan that is broadcast is below 3 * capacity * sqrt(2 * capacity) slots
of 48 bytes (19 MB for 2048 tokens) for any corpus. Ranks are counted in slices of rows, so a length that a third of all
pieces share is dealt over many tasks.

Defined results: a null or empty text has one piece, the end mark alone; a text of exactly ``capacity`` tokens is one piece;
of longer ones the first piece is the shorter one; rows may repeat and doc_id may be null; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gablestat.llm.bpe import bulk, encoder, id_lists
from gablestat.session import cut_lineage

CAPACITY = 2048
#: Rows whose ranks one task counts.
SLICE_ROWS = 200_000


def pieces(
    docs: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), end: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every document's ids and an end mark, cut to ``capacity``: ``key piece start length ids_crc32`` and, if asked, ``ids``."""
    kind = docs.schema[key].dataType.simpleString()
    mark = np.array([end], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, special)
        for batch in batches:
            for row, flat, offs in bulk(batch.column(1), own):
                rows, starts, numbers, sizes, sums, cut = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    ids = np.concatenate([flat[a:b], mark]).astype("<u4").tobytes()
                    n = b - a + 1
                    stop = (n - 1) % capacity + 1
                    start, number = 0, 0
                    while start < n:
                        part = ids[4 * start : 4 * stop]
                        rows.append(row + i)
                        numbers.append(number)
                        starts.append(start)
                        sizes.append(stop - start)
                        sums.append(zlib.crc32(part))
                        if with_ids:
                            cut.append(part)
                        start, stop, number = stop, stop + capacity, number + 1
                columns = [batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, id_lists(cut)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def plan(
    counts: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0), by: str = "norm",
) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """How often each kind of sequence is used and its pieces as runs of (length, number).

    ``weights`` are those of tokens, documents and attention, each as a share of its capacity. ``by`` is ``norm``: least
    weighted norm of what is left, or ``dot``: greatest weighted dot product of need and what is left, ties to the fullest.
    """
    limits = (capacity, documents or capacity, attention or capacity * capacity)
    scale = [w / c for w, c in zip(weights, limits)]
    bins: dict[tuple[int, int, int], dict[tuple[tuple[int, int], ...], int]] = {}
    order: list[tuple[int, int, int]] = []  # what bins have left, ascending

    def add(left: tuple[int, int, int], runs: tuple, n: int) -> None:
        if left not in bins:
            bins[left] = {}
            bisect.insort(order, left)
        bins[left][runs] = bins[left].get(runs, 0) + n

    def put(left, runs, need, n):
        after = tuple(x - y for x, y in zip(left, need))
        length = need[0]
        runs = (*runs[:-1], (length, runs[-1][1] + 1)) if runs and runs[-1][0] == length else (*runs, (length, 1))
        add(after, runs, n)

    for length in sorted(counts, reverse=True):
        need, waiting = (length, 1, length * length), counts[length]
        if need[0] > limits[0] or need[2] > limits[2]:
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while waiting:
            best, score = None, None
            for left in order[bisect.bisect_left(order, (length, 0, 0)) :]:
                if left[1] < 1 or left[2] < need[2]:
                    continue
                if by == "dot":
                    worth = (-sum(s * s * x * y for s, x, y in zip(scale, left, need)), left[0])
                else:
                    worth = (sum((s * (x - y)) ** 2 for s, x, y in zip(scale, left, need)), left[0])
                if score is None or worth < score:
                    best, score = left, worth
                if by == "norm" and not any(weights[1:]):
                    break  # ascending by tokens left: the first that fits is best
            if best is None:
                # none fits: open bins that hold as many pieces of this length as every capacity lets them
                fit = min(limits[0] // need[0], limits[1], limits[2] // need[2])
                opened, rest = divmod(waiting, fit)
                for n, many in ((opened, fit), (1 if rest else 0, rest)):
                    if n:
                        add(tuple(c - many * x for c, x in zip(limits, need)), ((length, many),), n)
                break
            runs = next(iter(bins[best]))
            n = bins[best].pop(runs)
            if not bins[best]:
                del bins[best]
                order.pop(bisect.bisect_left(order, best))
            used = min(n, waiting)
            if n > used:
                add(best, runs, n - used)
            put(best, runs, need, used)
            waiting -= used
    return [(n, runs) for kinds in bins.values() for runs, n in kinds.items()]


def _slots(kinds: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, np.ndarray]:
    """For each length its slots by rank: columns first rank, pieces in a row, first sequence, offset of the first piece."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, runs in kinds:
        offset = 0
        for length, many in runs:
            rank = ranks.get(length, 0)
            slots.setdefault(length, []).append((rank, many, sequence, offset))
            ranks[length] = rank + n * many
            offset += length * many
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in slots.items()}


def pack(rows: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", **limits) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``limits`` as of ``plan``."""
    rows = cut_lineage(rows)
    counted = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    slots = rows.sparkSession.sparkContext.broadcast(_slots(plan({r["length"]: r["n"] for r in counted}, capacity, **limits)))
    parts = max(1, -(-sum(r["n"] for r in counted) // SLICE_ROWS))
    # rank among the pieces of a length: rank in a slice, after the counts of the slices before it
    sliced = cut_lineage(rows.withColumn("_slice", F.pmod(F.xxhash64(key, "piece", "start"), F.lit(parts)).cast("int")))
    before = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n")).drop("_n")
    own = Window.partitionBy("length", "_slice").orderBy(key, "piece", "start", "ids_crc32")
    ranked = sliced.withColumn("_rank", F.row_number().over(own) - 1).join(before, ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    kept = rows.columns
    ranked = ranked.select(*kept, "_rank")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(order)]):
                at = order[a:b]
                table = slots.value[int(lengths[at[0]])]
                slot = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
                within = ranks[at] - slot[:, 0]
                sequence[at] = slot[:, 2] + within // slot[:, 1]
                offset[at] = slot[:, 3] + within % slot[:, 1] * lengths[at[0]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(look_up, schema)
