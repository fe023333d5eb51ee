"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear score over binned text statistics, by minimising the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). Labels of bad text are
never used. Statistics: shares of character classes, repetition of words and lines, lengths; each is cut into bins at
quantiles over all rows of the table.

The class prior is estimated, too. A first score tells half of the positives from half of the unlabelled sample; then the
whole table is scored, and the prior is the least ratio, over thresholds, of the share of all rows above the threshold to the
share of the other half of the positives above it, with a bound on the chance error of either share added when the
threshold is chosen. Above a threshold that only good text reaches, that ratio is the share of good text.

The gradient is taken over at most ``POSITIVES`` positives (labelled rows) and ``UNLABELLED`` rows of unlabelled text, picked
by a hash: a bound on the sums each of some hundred rounds runs over, a parameter of ``fit``; the quantiles, the prior, the
statistics and the scores cover every row and whole texts.

Defined cases: null and empty texts have zero statistics and are scored; very long texts are read whole; repeated rows are
scored one by one and alike; labels of null or unknown doc_ids say nothing; a doc_id is positive if any of its labels is;
without positives every score is 0.5; an empty table gives no rows; columns stats and quality_score of the input are
replaced by the operator's.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.llm.common import distinct_sample, map_texts, rows_of, spread_sample, utf8

POSITIVES = 6000
UNLABELLED = 12_000
THRESHOLD = 0.5
#: Bins of scores that the prior is estimated from.
LEVELS = 1000
#: Where the bins of each statistic are cut, as shares of the training texts; finer at the ends, where bad text lies.
CUTS = (0.01, 0.03, *(i / 12 for i in range(1, 12)), 0.97, 0.99)
BINS = len(CUTS) + 1
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.uint8)
for _i, _c in enumerate(_PUNCTUATION):
    _CLASS[_c] = _i + 1
_N = len(_PUNCTUATION)
for _k, _chars in enumerate((range(48, 58), range(65, 91), range(97, 123), (32,), (10, 13), range(128, 256)), 1):
    for _c in _chars:
        _CLASS[_c] = _N + _k
CLASSES = _N + 7
STATISTICS = CLASSES + 8


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics for each text."""
    out = np.zeros((len(texts), STATISTICS), np.float32)
    sizes = np.array([len(t) for t in texts])
    classes = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    at = 0
    for i, n in enumerate(sizes):
        if n:
            out[i, :CLASSES] = np.bincount(classes[at : at + n], minlength=CLASSES)[:CLASSES] / n
            at += n
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        n, counts = len(words), Counter(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, CLASSES:] = (
            len(counts) / n**0.8, counts.most_common(1)[0][1] / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines),
            len(text) / n, np.log1p(n), n / len(lines), sum(map(bytes.isupper, words)) / n,
        )
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and stats, the statistics of each whole text."""
    keep = [c for c in keep if c.lower() != "stats"]

    def make():
        return lambda texts: (pa.array(list(statistics(utf8(texts)).astype(np.float32)), pa.list_(pa.float32())),)

    return map_texts(docs, make, ["text"], keep, [T.StructField("stats", T.ArrayType(T.FloatType()))])


class QualityModel:
    """Bins, weights and prior; ``score`` gives the probability of good text."""

    def __init__(self, edges: np.ndarray | None = None, prior: float = 0.5):
        """edges: where each statistic is cut; without any every score is the prior."""
        self.edges, self.prior, self.weights = edges, prior, None

    def learn(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600) -> QualityModel:
        self.prior = prior
        if self.edges is not None and len(positives) and len(unlabelled):
            self.weights = self._descend(self._bins(positives), self._bins(unlabelled), rounds)
        return self

    @property
    def _width(self) -> int:
        return len(self.edges) * BINS

    def _bins(self, x: np.ndarray) -> np.ndarray:
        """The number of each statistic's bin, among all bins of all statistics."""
        return np.stack([j * BINS + np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def _descend(self, p: np.ndarray, u: np.ndarray, rounds: int, rate: float = 0.05, ridge: float = 2e-4) -> np.ndarray:
        """Weights and shift by Adam on the non-negative risk; where its negative part falls below 0, that part is climbed."""
        n = self._width
        w = np.zeros(n + 1)
        first, second = np.zeros(n + 1), np.zeros(n + 1)

        def gradient(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(rows.ravel(), np.repeat(g, rows.shape[1]), n), g.sum())

        w[n] = np.log(self.prior / (1 - self.prior))
        for t in range(1, rounds + 1):
            mp, mu = w[p].sum(axis=1) + w[n], w[u].sum(axis=1) + w[n]
            sp, su = 1 / (1 + np.exp(-mp)), 1 / (1 + np.exp(-mu))
            negative = np.logaddexp(0, mu).mean() - self.prior * np.logaddexp(0, mp).mean()
            down = gradient(u, su / len(u)) - gradient(p, self.prior * sp / len(p))
            g = -down if negative < 0 else gradient(p, self.prior * (sp - 1) / len(p)) + down
            g[:n] += ridge * w[:n]
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return w

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        m = self.weights[self._bins(stats)].sum(axis=1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(m, -60, 60)))


def share_of_positives(unlabelled: np.ndarray, positives: np.ndarray, surely: float = 0.05) -> float:
    """The class prior from counts of scores in equal bins, from 0 to 1, of all rows and of positives not learned from."""
    n_u, n_p = max(1, unlabelled.sum()), max(1, positives.sum())
    above_u, above_p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positives[::-1]) / n_p
    wide = sum(np.sqrt(np.log(4 / surely) / (2 * n)) for n in (n_u, n_p))
    some = above_p > 0
    if not some.any():
        return 0.5
    u, p = above_u[some], above_p[some]
    at = int(np.argmin((u + wide) / p))
    return float(np.clip(u[at] / p[at], 0.02, 0.98))


def _counts(stats: DataFrame, model: QualityModel) -> np.ndarray:
    """How many rows of the table have a score in each of LEVELS bins."""
    found = score(stats, model, []).select(F.least(F.floor(F.col("quality_score") * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("k"))
    out = np.zeros(LEVELS)
    for r in found.groupBy("k").count().collect():
        out[r.k] = r["count"]
    return out


def fit(stats: DataFrame, labels: DataFrame, trained: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """A model of rows (doc_id, stats): positives are the trained rows labelled 1, unlabelled are all rows."""
    marks = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & trained).select("doc_id").distinct()
    rows = lambda found: np.array([r.stats for r in found], np.float32).reshape(-1, STATISTICS)
    p = rows(distinct_sample(rows_of(stats, marks, "doc_id", positives), "stats", positives))
    if not len(p):
        return QualityModel()
    each = F.array(*[F.percentile_approx(F.col("stats")[j], list(CUTS), 2000) for j in range(STATISTICS)])
    model = QualityModel(np.array(stats.agg(each).first()[0], float))
    u = rows(spread_sample(stats, "stats", unlabelled))
    own, other = p[::2], p[1::2] if len(p) > 1 else p
    first = QualityModel(model.edges).learn(own, u[::2], 0.5, rounds=200)
    held = np.bincount(np.minimum((first.score(other) * LEVELS).astype(int), LEVELS - 1), minlength=LEVELS)
    return model.learn(p, u, share_of_positives(_counts(stats, first), held))


def score(stats: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with quality_score."""
    keep = [c for c in keep if c.lower() != "quality_score"]
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(column: pa.Array):
            return (model.score(np.array(column.to_pylist(), np.float32).reshape(-1, STATISTICS)),)

        return work

    return map_texts(stats, make, ["stats"], keep, [T.StructField("quality_score", T.DoubleType())])
