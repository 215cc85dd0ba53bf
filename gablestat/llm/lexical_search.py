"""Ranked lexical search by scanning documents with an Aho-Corasick automaton of all query terms.

No index of the documents is built or kept. The automaton of all terms of all items is broadcast; a scan replaces every
byte that parts terms by a blank and puts a blank around the text, and the automaton's patterns have a blank on either
side as their guard, so that it reports whole terms only. Neighbouring terms share a blank, and overlapping matches
are all reported. Patterns and texts are compared as bytes: the guards are ASCII, so no match begins or ends inside
a character.

Two scans give the result. The first counts the collection (documents, terms) and in how many documents each term of
the automaton occurs. The second counts term frequencies again and turns them into scores at once: the output of the
automaton for a term leads to the items that have it, a task keeps the best documents of each item, and those meet in
one ranking. Nothing per document is stored between the scans.

Items are dealt to blocks of about ``BLOCK`` bytes of text by a hash, one automaton for each block, so the broadcast
stays bounded for any number of items (an item of a longer text is bounded by its own row).

Defined results: a null text holds no terms; a document without terms counts nowhere; an item without terms has no
rows; rows of one item id are one item, whose terms are those of all its rows; repeated documents are ranked each for
itself, a null document id after others of its score; equal scores go by ascending id; an empty table gives no rows;
other columns are ignored; texts are scanned whole, in memory that follows the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gablestat.llm.words import buffers
from gablestat.session import cut_lineage

#: Bytes of item texts that share one automaton.
BLOCK = 1 << 20
#: Documents whose scores are held together by a task, and scores (documents by items) at most.
ROWS, CELLS = 1024, 1 << 20
#: Groups in which the documents of an item are ranked first.
GROUPS = 16
#: Weights of the length correction, in hundredths, and of the term frequency.
SLOPE, SCALE = 25, 12
_APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_TABLE = bytes(32 if _APART[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _scanned(column: pa.Array) -> Iterator[str]:
    """Texts with blanks for all that parts terms, lower case, a blank around each; one character for each byte."""
    data, offsets = buffers(column)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield " " + data[start:stop].tobytes().translate(_TABLE).decode("latin-1") + " "


def _length(text: str) -> int:
    """The number of terms: places where a blank ends and a term begins."""
    blank = np.frombuffer(text.encode("latin-1"), dtype=np.uint8) == 0x20
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, with repeats, as the scan sees them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).decode("latin-1").split(" ")


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Reports the place of each guarded term in ``terms``."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term} ", i)
    found.make_automaton()
    return found


def _frequencies(automaton, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms that occur in a text and how often."""
    counted = Counter(map(itemgetter(1), automaton.iter(text)))
    return np.fromiter(counted.keys(), dtype=np.int64, count=len(counted)), np.fromiter(counted.values(), dtype=np.int64, count=len(counted))


def _collection(docs: DataFrame, terms, text: str) -> DataFrame:
    """``term n``: documents with the term; -1 for all documents with terms, -2 for all terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(terms.value)
        held = np.zeros(len(terms.value), dtype=np.int64)
        documents = length = 0
        for batch in batches:
            for own in _scanned(batch.column(0)):
                n = _length(own)
                documents, length = documents + (n > 0), length + n
                held[_frequencies(automaton, own)[0]] += 1
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([held[some], [documents, length]]))], names=["term", "n"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Postings:
    """From a term to the items that have it and how often."""

    def __init__(self, items: list[list[tuple[int, int]]]):
        pairs = sorted((term, item, n) for item, own in enumerate(items) for term, n in own)
        self.items = len(items)
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        many = max((t for t, _, _ in pairs), default=-1) + 1
        self.first = np.searchsorted(table[:, 0], np.arange(many + 1))
        self.item, self.n = table[:, 1], table[:, 2]

    def add(self, scores: np.ndarray, row: int, terms: np.ndarray, gains: np.ndarray) -> None:
        """Adds the gains of a document's terms to the scores of all items that have them."""
        sizes = self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[terms] - ends + sizes, sizes)
        np.add.at(scores[row], self.item[at], np.repeat(gains, sizes) * self.n[at])


class _Best:
    """The first ``top`` documents of every item so far, by score, then id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor = np.ones(items, dtype=np.int64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        self.item, self.score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        self.doc, self.null = np.concatenate([self.doc, docs[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        order = order[place < self.top]
        self.item, self.score, self.doc, self.null = self.item[order], self.score[order], self.doc[order], self.null[order]
        full = place == self.top - 1
        self.floor[item[full]] = self.score[np.flatnonzero(place[place < self.top] == self.top - 1)]


def _scored(docs: DataFrame, block, documents: int, length: int, top: int, key: str, text: str) -> DataFrame:
    """``item_id doc_id score``: the best documents of every item of a block, in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, items, names = block.value
        automaton, postings, weight = _automaton(terms), _Postings(items), np.array(weights, dtype=np.int64)
        best = _Best(postings.items, top)
        rows = max(1, min(ROWS, CELLS // max(postings.items, 1)))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, rows):
                part = ids.slice(start, rows)
                scores = np.zeros((len(part), postings.items), dtype=np.int64)
                for row, own in enumerate(_scanned(texts.slice(start, rows))):
                    found, tf = _frequencies(automaton, own)
                    if len(found):
                        m = 100 - SLOPE + SLOPE * _length(own) * documents // length
                        postings.add(scores, row, found, weight[found] * (1_000_000_000 * tf // (1000 * tf + SCALE * m)))
                best.add(scores, part.fill_null(0).to_numpy(), part.is_null().to_numpy(zero_copy_only=False))
        found = pa.array(best.doc, mask=best.null) if len(best.doc) else pa.array([], pa.int64())
        yield pa.record_batch([pa.array([names[i] for i in best.item], pa.int64()), found, pa.array(best.score)], names=["item_id", "doc_id", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def _block(items: DataFrame, docs: DataFrame, top: int, key: str, text: str) -> DataFrame | None:
    """The ranking of one block of items, which the driver holds with its terms."""
    spark = docs.sparkSession
    own: dict[int | None, Counter] = {}
    for r in items.collect():
        own.setdefault(r.item_id, Counter()).update(t for t in terms_of(r.text) if t)
    terms = sorted({t for counted in own.values() for t in counted})
    if not terms:
        return None
    place = {t: i for i, t in enumerate(terms)}
    counts = _collection(docs, spark.sparkContext.broadcast(terms), text)
    total = F.max(F.when(F.col("term") == -1, F.col("n")))
    stored = {r.term: r.n for r in counts.collect()}  # one row for each term of the block at most
    documents, length = stored.pop(-1, 0), stored.pop(-2, 0)
    if not documents:
        return None
    held = [stored.get(i, 0) for i in range(len(terms))]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * np.array(held, dtype=np.float64) + 1))).astype(np.int64).tolist()
    ids = sorted(own, key=lambda i: (i is None, i or 0))
    block = spark.sparkContext.broadcast((terms, weights, [sorted((place[t], n) for t, n in own[i].items()) for i in ids], ids))
    found = _scored(docs, block, documents, length, top, key, text)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # what the tasks keep of an item is ranked in groups first, so that its last task gets a bounded number of rows
    grouped = found.withColumn("_g", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    first = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_g").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_id rank doc_id score``: the first ``top`` documents of each item (``item_id text``) with a score above 0.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document adds, for each of an item's terms with repeats, that
    weight times (10^9 tf) div (1000 tf + 12 m), where m = 75 + (25 n N) div L corrects for its length n.
    """
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    out = None
    for i in range(blocks):
        one = _block(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), docs, top, key, text)
        if one is not None:
            one = cut_lineage(one) if blocks > 1 else one
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
