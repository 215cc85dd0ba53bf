"""Toxicity by nearest labelled examples.

A text is the TF-IDF vector of the words that labelled examples tie to toxicity, normalised. Its nearest examples by cosine
are found exactly in an inverted index whose postings lie in blocks of examples: for every word and block the index knows the
largest weight, so the sum over a text's words bounds the cosine of a whole block from above, and blocks that can't reach the
nearest found so far are not looked into. Neighbours vote, each by a power of its cosine; votes are calibrated to shares of
toxic texts by isotonic regression over the labelled texts, each judged without itself. A label's examples count for all
rows of that label, so shares are those of the whole labelled table at every size. The nearest examples are the evidence.

Bounds: at most ``SAMPLE`` labelled rows of each label (those of smallest hash) are learned from, ``WORDS`` words and
``EXAMPLES`` examples of each label make the index; these rows, words and weights are all that is broadcast (about 1 MB).
The words' document frequencies are counted over all documents.

Defined results: a null or empty text, and one without any of the words, gets the share of toxic texts among such labelled
ones; without labelled rows that share is 0; labels that repeat count as toxic if one does; rows may repeat; an empty table
gives no rows; other columns are kept, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestat.llm.words import buffers, sliced_bytes
from gablestat.session import cut_lineage

SAMPLE, WORDS, EXAMPLES, NEIGHBOURS, BLOCK = 8_000, 1_024, 1_500, 16, 64
_BYTES = np.arange(256)
#: What parts words: ASCII but letters and digits.
_PART = (_BYTES < 0x80) & ~(((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)))


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Word hashes of each row's text, lower case."""
    for at, words in sliced_bytes(*buffers(column), _PART, lower=True):
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            yield at + i, words.hash[a:b]


def _known(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary of those words that it holds."""
    if not len(vocabulary):
        return np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return at[vocabulary[at] == words]


class BlockMaxIndex:
    """Exact nearest rows by cosine. ``rows`` are (places, weights) of unit vectors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], words: int, block: int = BLOCK):
        order = sorted(range(len(rows)), key=lambda i: (int(rows[i][0][np.argmax(rows[i][1])]), i))  # like by like in a block
        self.original, self.block = np.array(order, dtype=np.int64), block
        self.blocks = -(-len(rows) // block)
        place = [np.full(len(rows[i][0]), n) for n, i in enumerate(order)]
        word = [rows[i][0] for i in order]
        weight = [rows[i][1] for i in order]
        place, word, weight = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((place, np.int64), (word, np.int64), (weight, np.float64)))
        by = np.lexsort((place, word))
        self.place, self.weight = place[by], weight[by]
        # postings of word w in block b are start[w * blocks + b] to the next
        cell = word[by] * self.blocks + self.place // block
        self.start = np.searchsorted(cell, np.arange(words * self.blocks + 1))
        self.most = np.zeros((words, self.blocks))
        np.maximum.at(self.most.reshape(-1), cell, self.weight)

    def nearest(self, words: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Original places and cosines of the ``k`` nearest rows with a positive cosine; ties to the earlier place."""
        bounds = weights @ self.most[words]
        found = np.zeros(0, dtype=np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(found[1]) >= k and bounds[b] < found[1][-1]:
                break
            sims = np.zeros(self.block)
            for w, x in zip(words.tolist(), weights.tolist()):
                cut = slice(self.start[w * self.blocks + b], self.start[w * self.blocks + b + 1])
                sims[self.place[cut] - b * self.block] += x * self.weight[cut]
            hit = np.flatnonzero(sims > 0)
            ids = self.original[hit + b * self.block]
            ids, sims = np.concatenate([found[0], ids[ids != without]]), np.concatenate([found[1], sims[hit][ids != without]])
            by = np.lexsort((ids, -sims))[:k]
            found = ids[by], sims[by]
        return found


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing weighted least squares fit: values of x, and the fit from there."""
    by = np.argsort(x, kind="stable")
    values, at = np.unique(x[by], return_index=True)
    total, weight = np.add.reduceat((y * w)[by], at), np.add.reduceat(w[by], at)
    blocks: list[list[float]] = []
    for v, t, n in zip(values, total, weight):
        blocks.append([v, t, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, t2, n2 = blocks.pop()
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class ToxicityScorer:
    """Learned from labelled documents by ``fit``, applied by ``transform``."""

    def __init__(self, neighbours: int = NEIGHBOURS, power: float = 4.0, sample: int = SAMPLE, words: int = WORDS, examples: int = EXAMPLES):
        self.neighbours, self.power, self.sample, self.words, self.examples = neighbours, power, sample, words, examples
        self.vocabulary, self.idf = np.zeros(0, np.uint64), np.zeros(0)
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.labels, self.ids, self.base = np.zeros(0), [], 0.0
        self.scale = self.each = np.ones(2)  # rows of each label (0, 1) that a learned row, and an example, stands for
        self.steps = np.zeros(1), np.zeros(1)

    def _vector(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(_known(self.vocabulary, words), return_counts=True)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / np.sqrt((x * x).sum()) if len(x) else x

    def _vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = sims**self.power
        w = w * self.each[self.labels[ids].astype(np.int64)]
        return float((w * self.labels[ids]).sum() / w.sum()) if len(w) else -1.0

    def fit(self, docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> "ToxicityScorer":
        """Learns from ``docs`` with a label; ``corpus`` (default ``docs``) gives document frequencies."""
        one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
        labelled = {int(r["_label"]): r["n"] for r in one.where(F.col("_label").isin(0, 1)).groupBy("_label").agg(F.count("*").alias("n")).collect()}
        self.scale = np.array([max(1.0, labelled.get(v, 0) / self.sample) for v in (0, 1)])
        by = (F.xxhash64("_key"), F.col("_key"))
        picked = [one.where(F.col("_label") == v).orderBy(*by).limit(self.sample) for v in (0, 1)]
        # at most 2 * sample rows of a key and a label
        known = docs.select(key, text).join(F.broadcast(cut_lineage(picked[0].unionByName(picked[1]))), F.col(key) == F.col("_key"))
        known = cut_lineage(known.select("_key", "_label", F.coalesce(F.col(text), F.lit("")).alias("text")))

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = batch.column(1).to_numpy()
                parts = [(np.unique(w), i) for i, w in _words(batch.column(0))]
                if parts:
                    words = np.concatenate([w for w, _ in parts])
                    toxic = np.repeat([label[i] for _, i in parts], [len(w) for w, _ in parts]).astype(np.int64)
                    terms, at = np.unique(words, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(terms.view(np.int64)), pa.array(np.bincount(at)), pa.array(np.bincount(at, weights=toxic).astype(np.int64))], names=["word", "n", "toxic"])

        totals = known.groupBy("_label").agg(F.count("*").alias("n")).collect()
        size = {int(r["_label"]): r["n"] for r in totals}
        if not size.get(1):
            return self
        n = sum(size.values())
        # weights of clean and toxic rows that give their shares among all labelled rows, and no more evidence than was sampled
        clean, toxic = (float(x) for x in self.scale * n / sum(self.scale[v] * k for v, k in size.items()))
        share = toxic * size[1] / n
        counted = known.select("text", F.col("_label").cast("long").alias("l")).mapInArrow(distinct, "word long, n long, toxic long")
        counted = counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("n >= 4")
        weight = clean * (F.col("n") - F.col("toxic")) + toxic * F.col("toxic")
        excess = (toxic * F.col("toxic") - weight * share) / F.sqrt(weight * share * (1 - share) + 1e-9)
        best = counted.withColumn("z", excess).where("z > 4").orderBy(F.desc("z"), "word").limit(self.words).collect()
        self.vocabulary = np.sort(np.array([r["word"] for r in best], dtype=np.int64).view(np.uint64))
        self.idf = np.ones(len(self.vocabulary))
        self._weigh(corpus if corpus is not None else docs, text)
        self._index(known, n)
        return self

    def _weigh(self, corpus: DataFrame, text: str) -> None:
        """Inverse document frequencies of the words over all documents."""
        vocabulary = self.vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(vocabulary), dtype=np.int64), 0
            for batch in batches:
                for _, words in _words(batch.column(0)):
                    n += 1
                    total[_known(vocabulary, words)] += 1  # a word counts once a document
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["at", "n"])

        rows = corpus.select(text).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        found = {r["at"]: r["n"] for r in rows}
        n = found.pop(-1, 0)
        for at, df in found.items():
            self.idf[at] = np.log((1 + n) / (1 + df)) + 0.1

    def _index(self, known: DataFrame, n: int) -> None:
        """Examples with any of the words, the base share of those without, and the calibration."""
        vocabulary = self.vocabulary

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [_known(vocabulary, w).tolist() for _, w in _words(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32()))], names=["_key", "_label", "at"])

        kinds = known.schema
        vectors = known.mapInArrow(hits, f"_key {kinds['_key'].dataType.simpleString()}, _label {kinds['_label'].dataType.simpleString()}, at array<int>")
        # places repeat as words do; their number is bounded by the counts of at most ``words`` words, kept as counts
        runs = vectors.select("_key", "_label", F.array_distinct("at").alias("d"), "at").select(
            "_key", "_label", "d", F.transform("d", lambda d: F.size(F.filter("at", lambda x: x == d))).alias("n")).orderBy(F.xxhash64("_key"), "_key").collect()
        empty = [r["_label"] for r in runs if not r["d"]]
        weigh = lambda labels: self.scale[np.array(labels, dtype=np.int64)]
        self.base = float(np.average(empty, weights=weigh(empty))) if empty else 0.0
        full = [r for r in runs if r["d"]]
        chosen = [r for v in (0, 1) for r in [x for x in full if x["_label"] == v][: self.examples]]
        self.rows = [self._weights(np.array(r["d"]), np.array(r["n"])) for r in chosen]
        self.labels, self.ids = np.array([float(r["_label"]) for r in chosen]), [r["_key"] for r in chosen]
        if not chosen:
            return
        of = [sum(r["_label"] == v for r in full) for v in (0, 1)]
        self.each = self.scale * [max(1.0, k / self.examples) for k in of]
        index = BlockMaxIndex(self.rows, len(self.vocabulary))
        votes = np.array([self._vote(*index.nearest(*self._weights(np.array(r["d"]), np.array(r["n"])), self.neighbours, self._own(r["_key"]))) for r in full])
        votes, labels = np.append(votes, -1.0), np.append([float(r["_label"]) for r in full], self.base)
        weights = np.append(weigh([r["_label"] for r in full]), max(weigh(empty).sum(), 1))
        self.steps = _isotonic(votes, labels, weights)

    def _own(self, key) -> int:
        if not hasattr(self, "_at"):
            self._at = {k: i for i, k in enumerate(self.ids)}
        return self._at.get(key, -1)

    def _weights(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(at)
        at, n = at[by].astype(np.int64), n[by]
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def transform(self, docs: DataFrame, key: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
        """The rows with ``score`` and ``evidence``, the nearest examples (``doc_id label cosine``)."""
        kept = [c for c in docs.columns if c not in ("score", "evidence")]
        place = kept.index(text)
        kind = "string"
        model = docs.sparkSession.sparkContext.broadcast(self)
        k = self.neighbours

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            index = BlockMaxIndex(own.rows, len(own.vocabulary))
            values, fit = own.steps

            def calibrated(vote: float) -> float:
                return float(fit[max(0, int(np.searchsorted(values, vote, side="right")) - 1)])

            for batch in batches:
                score, near = np.full(batch.num_rows, calibrated(-1.0)), [[] for _ in range(batch.num_rows)]
                for i, words in _words(batch.column(place)):
                    at, weights = own._vector(words)
                    if len(at) and own.rows:
                        ids, sims = index.nearest(at, weights, k)
                        score[i] = calibrated(own._vote(ids, sims))
                        near[i] = [{"doc_id": str(own.ids[j]), "label": int(own.labels[j]), "cosine": float(s)} for j, s in zip(ids[:evidence], sims[:evidence])]
                shape = pa.list_(pa.struct([("doc_id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(kept))), pa.array(score), pa.array(near, shape)], names=[*kept, "score", "evidence"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
        return docs.select(*kept).mapInArrow(run, f"{schema}, score double, evidence array<struct<doc_id: {kind}, label: int, cosine: double>>")
