"""Language identification by nearest centroid.

A text is the vector of its hashed byte n-grams (two and three bytes, lower case, signs and digits as spaces), weighted
by TF-IDF and normalised. Each language has a few centroids, found by spherical k-means over a bounded sample of its labelled
texts; a text gets the language of the centroid of greatest cosine. ``rejected`` tells that this cosine is lower than
the texts of that cluster explain.

Bounds: n-gram document frequencies cover all labelled texts and are ``DIMENSIONS`` counts; k-means sees about
``SAMPLE`` texts of each language (chosen by a hash of key and text, rows that repeat once); the centroids broadcast are ``CLUSTERS * DIMENSIONS`` floats a language.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and rejected; without any labelled
text all are; rows may repeat; a labelled text without n-grams teaches nothing; an empty table gives no rows; other columns
are kept, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestat.llm.words import buffers
from gablestat.session import cut_lineage

DIMENSIONS, CLUSTERS, SAMPLE, SEED = 1 << 13, 4, 400, 11
#: A table of at most this many languages and their sizes is broadcast.
FEW_LANGUAGES = 20_000
_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_PLAIN = np.where(_UPPER, _BYTES + 32, np.where(_LOWER | (_BYTES >= 0x80), _BYTES, 0x20)).astype(np.uint32)
_SIZE = 1 << 20


def _counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """N-gram counts of each row's text."""
    data, offsets = buffers(column)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        total = np.zeros(DIMENSIONS, dtype=np.int64)
        for start in range(a, b, _SIZE):  # long texts in parts that overlap by two bytes
            x = _PLAIN[data[start : min(b, start + _SIZE + 2)]]
            two = x[:-1] * np.uint32(257) + x[1:]
            three = (two[:-1] * np.uint32(259) + x[2:]) * np.uint32(2654435761) >> np.uint32(32 - 13)
            two = two[: _SIZE] * np.uint32(40503 * 65537 & 0xFFFFFFFF) >> np.uint32(32 - 13)
            total += np.bincount(two, minlength=DIMENSIONS) + np.bincount(three[:_SIZE], minlength=DIMENSIONS)
        yield i, total


def _normal(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    size = np.sqrt((x * x).sum())
    return x / size if size else x


def _has_letter(data: np.ndarray) -> bool:
    if (_UPPER | _LOWER)[data].any():
        return True
    return bool((data >= 0x80).any()) and any(c.isalpha() for c in data.tobytes().decode())


def _cluster(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids, and for each the least cosine that its texts explain."""
    chosen = [0]
    for _ in range(1, min(k, len(vectors))):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centres = vectors[chosen]
    for _ in range(12):
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    sims = vectors @ centres.T
    own = sims.argmax(axis=1)
    floors = [float(s.mean() - 4 * s.std()) if len(s := sims[own == c, c]) else 0.0 for c in range(len(centres))]
    return centres.astype(np.float32), np.array(floors)


class LanguageId:
    """Learned from labelled texts by ``fit``, applied by ``transform``."""

    def __init__(self, clusters: int = CLUSTERS, sample: int = SAMPLE):
        self.clusters, self.sample = clusters, sample
        self.idf = np.zeros(DIMENSIONS, dtype=np.float32)
        self.languages: list[str] = []
        self.centres, self.floors = np.zeros((0, DIMENSIONS), np.float32), np.zeros(0)

    def fit(self, docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> "LanguageId":
        """Learns from the rows with a language and a text."""
        known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
            for batch in batches:
                for _, counts in _counts(batch.column(0)):
                    total += counts > 0
                    n += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *total[at].tolist()], pa.int64())], names=["gram", "n"])

        rows = known.select("text").mapInArrow(seen, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        found = {r["gram"]: r["n"] for r in rows}
        n = found.pop(-1, 0)
        df = np.zeros(DIMENSIONS)
        df[list(found)] = list(found.values())
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
        idf, clusters = self.idf, self.clusters

        def centroids(frame: pd.DataFrame) -> pd.DataFrame:
            vectors = np.stack([_normal(c, idf) for _, c in _counts(pa.array(frame["text"], pa.string()))])
            vectors = vectors[vectors.any(axis=1)]
            if not len(vectors):
                return pd.DataFrame({"lang": [], "centre": [], "floor": []})
            centres, floors = _cluster(vectors, clusters)
            return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "floor": floors})

        sizes = cut_lineage(known.groupBy("lang").agg(F.count("*").alias("_size")))
        if sizes.count() <= FEW_LANGUAGES:  # then texts stay where they are; otherwise a join that adaptive execution can split
            sizes = F.broadcast(sizes)
        share = F.pmod(F.xxhash64("key", "text", F.lit(SEED)), F.lit(1_000_003)) / 1_000_003
        some = known.join(sizes, "lang").where(share < F.lit(float(self.sample)) / F.col("_size"))
        # rows that repeat teach once, and are merged before they leave a task
        some = cut_lineage(some.groupBy("lang", "key", F.sha2("text", 256).alias("_tag")).agg(F.first("text").alias("text")).select("lang", "text"))
        learned = some.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, floor double").orderBy("lang", "centre").collect()
        self.languages = [r["lang"] for r in learned]
        if learned:
            self.centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in learned])
            self.floors = np.array([r["floor"] for r in learned])
        return self

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows with ``lang_pred score rejected``."""
        added = ("lang_pred", "score", "rejected")
        kept = [c for c in docs.columns if c not in added]
        place, languages, floors = kept.index(text), np.array([*self.languages, "und"], dtype=object), self.floors
        model = docs.sparkSession.sparkContext.broadcast((self.idf, self.centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, centres = model.value
            for batch in batches:
                n = batch.num_rows
                best, score, rejected = np.full(n, len(languages) - 1), np.zeros(n), np.ones(n, dtype=bool)
                column = batch.column(place)
                data, offsets = buffers(column)
                rows, vectors = [], []

                def flush():
                    if rows and len(centres):
                        sims = np.stack(vectors) @ centres.T
                        best[rows] = own = sims.argmax(axis=1)
                        score[rows] = top = np.clip(sims[np.arange(len(rows)), own], 0.0, 1.0)
                        rejected[rows] = top < floors[own]
                    rows.clear()
                    vectors.clear()

                for i, counts in _counts(column):
                    if _has_letter(data[offsets[i] : offsets[i + 1]]):
                        rows.append(i)
                        vectors.append(_normal(counts, idf))
                        if len(rows) == 256:
                            flush()
                flush()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j) for j in range(len(kept))), pa.array(languages[best], pa.string()), pa.array(score), pa.array(rejected)], names=[*kept, *added])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", lang_pred string, score double, rejected boolean"
        return docs.select(*kept).mapInArrow(run, schema)


def trainable(held_out: Column, key: Column) -> Column:
    """Rows to learn from: not held out, and with a key to tell."""
    return ~held_out & key.isNotNull()
