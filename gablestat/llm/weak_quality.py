"""Quality classifier from weak labels.

Several heuristic labellers look at each text and vote good (1), bad (-1) or abstain (0); they overlap and err. A text's votes
are one of few patterns, so all documents reduce to counts of patterns. Expectation-maximisation over these counts finds how
often each labeller gives each vote to good and to bad texts, and from that the posterior of every pattern. Posteriors are the
soft labels on which a linear scorer over hashed words and word shapes is trained; it scores every whole text.

Bounds: at most ``3 ** 9`` pattern counts reach the driver; the scorer is trained on about ``SAMPLE`` texts (chosen
by hash, patterns and posteriors cover all), of each the counts of its hashed features; ``DIMENSIONS`` weights are broadcast.

Defined results: a null, empty or blank text has only abstentions, a posterior like any such pattern's, and the scorer's
bias alone; rows may repeat; on an empty table nothing is learned and there are no rows; other columns are kept, those named
like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestat.llm.words import Words, buffers, mix, sliced_bytes

DIMENSIONS, SAMPLE, SEED = 1 << 16, 6_000, 5
#: Labellers: name, measure, bad if above, good if at most; between the two they abstain.
LABELLERS = (
    ("symbols", "symbols", 0.3, 0.1),
    ("marked", "marked", 0.3, 0.05),
    ("signs", "signs", 0.1, 0.06),
    ("exclaims", "exclaims", 0.8, 0.1),
    ("capitals", "capitals", 0.6, 0.3),
    ("echoes", "echoes", 0.25, 0.05),
    ("runs", "runs", 0.4, 0.1),
    ("lines", "lines", 0.55, 0.34),
    ("word_length", "word_length", 20.0, 14.0),
)
#: Kinds of bad texts, each first guessed from the labellers that look for it; EM then learns its own shares.
KINDS = (("symbols", "marked"), ("exclaims", "capitals"), ("echoes", "runs"), ("lines",), ("word_length",))
_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))
_SIGN = ((_BYTES > 32) & (_BYTES < 48)) | ((_BYTES > 57) & (_BYTES < 65)) | ((_BYTES > 90) & (_BYTES < 97)) | ((_BYTES > 122) & (_BYTES < 127))
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_SHAPES = 64


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return (sums[first[1:]] - sums[first[:-1]]).astype(np.float64)


def _measures(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """The labellers' measures of each text; not a number where there is nothing to measure."""
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    n = np.diff(words.first).astype(np.float64)
    letters, capitals = _per_text((_UPPER | _LOWER)[raw], at), _per_text(_UPPER[raw], at)
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    text = np.repeat(np.arange(words.n), np.diff(words.first))
    echo = np.zeros(len(words.hash), dtype=bool)
    echo[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    runs = np.zeros(words.n)
    three = words.hash[:-2] + mix(words.hash[1:-1]) + mix(mix(words.hash[2:])) if len(words.hash) > 2 else np.zeros(0, np.uint64)
    lines = np.full(words.n, np.nan)
    body = raw.tobytes()
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b - a > 2:
            own = three[a : b - 2]
            runs[i] = 1 - len(np.unique(own)) / len(own)
        if b > a:
            parts = [x for x in body[at[i] : at[i + 1]].split(b"\n") if x.strip()]
            lines[i] = 1 - len(set(parts)) / len(parts)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "symbols": _per_text(_SYMBOL[raw], at) / n, "marked": _per_text(marks[words.end] > marks[words.begin], words.first) / n,
            "signs": _per_text(_SIGN[raw], at) / np.where(n > 0, np.diff(at), np.nan), "exclaims": _per_text(raw == 33, at) / n, "capitals": capitals / letters,
            "echoes": _per_text(echo, words.first) / n, "runs": np.where(n > 2, runs, np.nan), "lines": lines,
            "word_length": np.where(n > 0, _per_text(words.end - words.begin, words.first) / n, np.nan),
        }


def _votes(measures: dict[str, np.ndarray]) -> np.ndarray:
    """One pattern number for each text, a digit (vote + 1) in base three for each labeller."""
    total = 0
    for _, name, bad, good in LABELLERS:
        x = measures[name]
        vote = np.where(np.isnan(x), 1, np.where(x > bad, 0, np.where(x <= good, 2, 1)))
        total = total * 3 + vote
    return total


def _features(words: Words, data: np.ndarray) -> np.ndarray:
    """Two hashed features of every word: the word, and its shape (marks in it, capitals, an echo, length)."""
    raw = data
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    exclaims = np.concatenate([[0], np.cumsum(raw == 33)])
    capitals = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    size = words.end - words.begin
    span = lambda s: s[words.end] - s[words.begin]
    echo = np.zeros(len(words.hash), dtype=np.int64)
    echo[1:] = words.hash[1:] == words.hash[:-1]
    shape = (span(marks) > 0) + 2 * (span(exclaims) > 0) + 4 * (2 * span(capitals) > size) + 8 * echo + 16 * np.minimum(size // 8, 3)
    return (words.hash >> np.uint64(48)).astype(np.int64) % (DIMENSIONS - _SHAPES) + _SHAPES, shape


def estimate(counts: dict[int, int], steps: int = 200) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Vote shares [labeller, class, vote], class shares, and each pattern's posterior of good, by expectation-maximisation.

    Class 0 is good, the others are the kinds of bad texts: within one class labellers err independently, while
    over all bad texts those that look for the same kind would not.
    """
    patterns = np.array(sorted(counts), dtype=np.int64)
    names = [name for name, *_ in LABELLERS]
    if not len(patterns):
        return np.zeros((len(names), 1 + len(KINDS), 3)), np.zeros(1 + len(KINDS)), {}
    weight = np.array([counts[int(p)] for p in patterns], dtype=np.float64)
    votes = np.stack([patterns // 3 ** (len(names) - 1 - j) % 3 for j in range(len(names))], axis=1)
    found = np.stack([(votes[:, [names.index(x) for x in kind]] == 0).sum(axis=1) for kind in KINDS], axis=1)
    classes = np.concatenate([np.where((votes == 0).any(axis=1, keepdims=True), 0.05, 0.95), 0.01 + found], axis=1)
    classes[:, 1:] *= (1 - classes[:, :1]) / classes[:, 1:].sum(axis=1, keepdims=True)
    for _ in range(steps):
        shares = np.empty((len(names), classes.shape[1], 3))
        for c in range(classes.shape[1]):
            for j in range(len(names)):
                seen = np.bincount(votes[:, j], weights=weight * classes[:, c], minlength=3) + 0.5
                shares[j, c] = seen / seen.sum()
        prior = (weight[:, None] * classes).sum(axis=0) / weight.sum()
        log = np.log(np.maximum(prior, 1e-12)) + sum(np.log(shares[j][:, votes[:, j]]).T for j in range(len(names)))
        after = np.exp(log - log.max(axis=1, keepdims=True))
        after /= after.sum(axis=1, keepdims=True)
        done = np.abs(after - classes).max() < 1e-9
        classes = after
        if done:
            break
    return shares, prior, {int(p): float(g) for p, g in zip(patterns, classes[:, 0])}


def _train(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on shares of hashed features with soft labels: weights and bias."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return weights, bias
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _, _ in rows])
    at, share = np.concatenate([a for a, _, _ in rows]), np.concatenate([x for _, x, _ in rows])
    label = np.array([y for _, _, y in rows])
    balance = np.where(label > 0.5, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3))
    first, second = np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(steps):
        score = np.bincount(row, weights=share * weights[at], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - label) * balance / len(rows)
        slope = np.bincount(at, weights=share * error[row], minlength=DIMENSIONS) + 1e-6 * weights
        first += slope**2
        second += error.sum() ** 2
        weights -= rate * slope / np.sqrt(first)
        bias -= rate * error.sum() / np.sqrt(second)
    return weights, float(bias)


class WeakQuality:
    """Learned from unlabelled documents by ``fit``, applied by ``transform``."""

    def __init__(self, sample: int = SAMPLE):
        self.sample = sample
        self.shares: np.ndarray | None = None
        self.prior = np.zeros(1 + len(KINDS))
        self.posteriors: dict[int, float] = {}
        self.weights, self.bias = np.zeros(DIMENSIONS), 0.0

    def fit(self, docs: DataFrame, text: str = "text") -> "WeakQuality":
        def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
            for batch in batches:
                data, offsets = buffers(batch.column(0))
                for at, words in sliced_bytes(data, offsets, lower=True):
                    found += np.bincount(_votes(_measures(data, offsets[at : at + words.n + 1], words)), minlength=len(found))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], names=["pattern", "n"])

        rows = docs.select(text).mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
        self.shares, self.prior, self.posteriors = estimate({r["pattern"]: r["n"] for r in rows})
        total, posteriors = sum(r["n"] for r in rows), self.posteriors
        share = F.pmod(F.xxhash64(text, F.lit(SEED)), F.lit(1_000_003)) / 1_000_003
        some = docs.select(text).where(F.col(text).isNotNull() & (share < self.sample / max(total, 1)))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffers(batch.column(0))
                out = ([], [], [])
                for at, words in sliced_bytes(data, offsets, lower=True):
                    cut = offsets[at : at + words.n + 1]
                    labels = _votes(_measures(data, cut, words))
                    pair = _features(words, data[cut[0] : cut[-1]])
                    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                        if b > a:
                            places, n = np.unique(np.concatenate([x[a:b] for x in pair]), return_counts=True)
                            for column, value in zip(out, (places.tolist(), (n / (b - a)).tolist(), posteriors.get(int(labels[i]), 0.5))):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64()))], names=["at", "share", "label"])

        gathered = some.mapInArrow(features, "at array<int>, share array<double>, label double").orderBy("label", "at").collect()
        self.weights, self.bias = _train([(np.array(r["at"]), np.array(r["share"]), r["label"]) for r in gathered])
        return self

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """For each labeller how often its vote on a good, and on a bad text is right, where it votes."""
        if self.shares is None:
            return {}
        bad = np.einsum("c,jcv->jv", self.prior[1:], self.shares[:, 1:])
        return {name: (float(g[2] / (g[2] + g[0])), float(b[0] / max(b[0] + b[2], 1e-12))) for (name, *_), g, b in zip(LABELLERS, self.shares[:, 0], bad)}

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows with ``pattern`` (votes), ``posterior``, ``score`` of the scorer, and ``kept`` (score of 0.5 or more)."""
        added = ("pattern", "posterior", "score", "kept")
        names = [c for c in docs.columns if c not in added]
        place = names.index(text)
        model = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias, self.posteriors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, bias, posteriors = model.value
            for batch in batches:
                data, offsets = buffers(batch.column(place))
                pattern, score = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
                for at, words in sliced_bytes(data, offsets, lower=True):
                    cut = offsets[at : at + words.n + 1]
                    rows = slice(at, at + words.n)
                    pattern[rows] = _votes(_measures(data, cut, words))
                    value = sum(weights[x] for x in _features(words, data[cut[0] : cut[-1]]))
                    score[rows] = _per_text(value, words.first) / np.maximum(np.diff(words.first), 1)
                score = 1 / (1 + np.exp(-np.clip(score + bias, -50, 50)))
                known = [posteriors.get(p, 0.5) for p in pattern.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j) for j in range(len(names))), pa.array(pattern), pa.array(known, pa.float64()), pa.array(score), pa.array(score >= 0.5)],
                    names=[*names, *added])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
        return docs.select(*names).mapInArrow(run, f"{schema}, pattern long, posterior double, score double, kept boolean")
