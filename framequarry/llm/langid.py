"""Language identification by error-correcting output codes.

Each language has a codeword of bits, chosen so that codewords lie far apart. For each bit a binary classifier over
hashed byte trigrams tells the languages with a 1 from those with a 0: its margin is the mean of its trigrams'
log odds, scaled and shifted by a logistic fit. Decoding weighs each bit's logistic loss by how well that bit's classifier
did in training; the codeword with the least loss wins, the score is its share of exp(-loss), and a text is flagged
ambiguous if the runner-up comes close.

Training takes at most ``PER_LANGUAGE`` distinct texts of a language (a documented bound on labelled rows; with very many languages
at most ``TEXTS`` over all of them, but no fewer than 20 of each), picked by a hash of the text, so that a doc_id or text
shared by many rows brings no more. Every language that occurs is learned. Defined cases: null texts and texts without a
letter (Unicode category L) are ``und`` with score 0; null languages are not learned from; equal texts get equal
predictions; very long texts are read whole, in parts; without any labelled text every prediction is ``und``; an empty
table gives no rows; columns of the input that bear the name of an added column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framequarry.llm.common import hashed_sample, map_texts, utf8, without

BUCKETS = 1 << 16
PER_LANGUAGE = 400
TEXTS = 100_000
AMBIGUOUS = 0.8
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, bytes of other letters as they are, all else a blank.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all texts, each with a blank at both ends, and where each text's begin."""
    data = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b"   ", np.uint8)]
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    starts = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
    code[starts[1:] - 1] = 0x202020  # else a text would see the first letter of the next
    return (code * np.uint32(2654435761)) >> np.uint32(16), starts


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1, picked from seeded draws for the largest least distance between rows."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    bits = max(7, 4 * int(np.ceil(np.log2(n))))
    best, found = -1, None
    for seed in range(200 if n <= 64 else 4):
        rows = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(rows.sum(axis=0, dtype=int)) == n).any():
            continue
        near = (rows.astype(np.int32) @ rows.T.astype(np.int32)) - 2 * bits * np.eye(n, dtype=np.int32)
        least = (bits - int(near.max())) // 2
        if least > best:
            best, found = least, rows
    return found if found is not None else np.where(np.arange(n)[:, None] >> np.arange(bits) & 1, 1, -1).astype(np.int8)


class LanguageModel:
    """The bits' classifiers; learn with ``fit``, predict with ``decode``."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs)).astype(np.float32)
        if not texts:
            return
        number = {x: k for k, x in enumerate(self.langs)}
        y = np.array([number[x] for x in langs])
        ones = self.code > 0
        yes, no = (np.zeros((ones.shape[1], BUCKETS)) for _ in range(2))
        for k in range(len(self.langs)):  # a language at a time: each side of a bit is the mean of its languages' shares
            counts = 0.2 + np.bincount(trigrams([texts[i] for i in np.flatnonzero(y == k)])[0], minlength=BUCKETS)
            share = counts / counts.sum()
            yes[ones[k]] += share
            no[~ones[k]] += share
        n_yes = ones.sum(axis=0)[:, None]
        n_no = len(ones) - n_yes
        both = ((n_yes > 0) & (n_no > 0))[:, 0]
        w = np.zeros_like(yes)
        w[both] = np.log(yes[both] / n_yes[both]) - np.log(no[both] / n_no[both])
        self.weights = np.ascontiguousarray(w.T, np.float32)
        self.scale, self.shift = np.ones(len(w), np.float32), np.zeros(len(w), np.float32)
        m, target = self._means(texts), self.code[y]
        good = []
        for b in range(len(w)):
            a, c = _logistic(m[:, b], target[:, b])
            self.scale[b], self.shift[b] = a, c
            good.append(np.mean(np.sign(a * m[:, b] + c) == target[:, b]))
        good = np.clip(np.array(good), 0.5, 0.999)
        self.trust = (np.log(good / (1 - good)) / np.log(999)).astype(np.float32)

    def _means(self, texts: list[bytes]) -> np.ndarray:
        grams, starts = trigrams(texts)
        bits = self.weights.shape[1]
        out = np.zeros((len(texts), bits), np.float32)
        stops = np.append(starts[1:], len(grams))
        step = 1 << 21
        for i in range(0, len(grams), step):  # in parts: a gathered row has as many floats as there are bits
            first, last = np.searchsorted(stops, i, "right"), np.searchsorted(starts, min(i + step, len(grams)), "left")
            inside = np.maximum(starts[first:last], i) - i
            out[first:last] += np.add.reduceat(self.weights[grams[i : i + step]], inside, axis=0)
        return out / (stops - starts)[:, None]

    def decode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the number of its language, its score, and the runner-up's share of the best."""
        m = self._means(texts) * self.scale + self.shift
        loss = (np.logaddexp(0, -m[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(axis=1), p.max(axis=1) / p.sum(axis=1), second


def _logistic(x: np.ndarray, sign: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge logistic fit of ``sign`` (-1 or 1) on x, by Newton steps; the slope isn't negative."""
    z = np.stack([x, np.ones_like(x)], axis=1).astype(float)
    y, w = (sign > 0).astype(float), np.zeros(2)
    spread = max(float(np.std(x)), 1e-6)
    ridge = np.diag([0.05 * spread**2, 1e-6]) * len(x) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5 / spread, 5 / spread)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, trained: Column | bool = True, per_language: int = PER_LANGUAGE, texts: int = TEXTS) -> LanguageModel:
    """A model of the rows where ``trained`` holds, from text and lang alone."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if trained is True else trained)).select("lang", "text")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], [])
    most = min(per_language, max(20, texts // len(counts)))
    share = rows.sparkSession.createDataFrame([(k, min(1.0, 1.5 * most / n)) for k, n in counts.items()], "lang string, share double")
    # first by the hash alone, which costs no shuffle of texts; equal texts all fall into the sample, or none, and count once
    some = hashed_sample(rows.join(F.broadcast(share), "lang"), "text", F.col("share")).select("lang", "text").distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    picked = some.withColumn("n", order).filter(F.col("n") <= most).select("text", "lang").collect()
    lost = sorted(set(counts) - {r.lang for r in picked})  # of a language with few distinct texts the hash may have taken none
    if lost:
        first = rows.join(F.broadcast(share.filter(F.col("lang").isin(lost)).select("lang")), "lang").groupBy("lang").agg(F.min("text").alias("text"))
        picked += first.select("text", "lang").collect()
    picked.sort(key=lambda r: (r.lang, r.text))
    return LanguageModel([r.text.encode() for r in picked], [r.lang for r in picked])


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with lang_pred, score and ambiguous; added columns win over clashing ones."""
    names = [f.name for f in FIELDS]
    docs = without(docs, names)
    keep = docs.columns if keep is None else [c for c in keep if c.lower() not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array):
            lettered = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
            if not model.langs:
                return ["und"] * len(lettered), [0.0] * len(lettered), [True] * len(lettered)
            best, score, second = model.decode(utf8(texts))
            return (
                [model.langs[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)],
                np.where(lettered, score, 0.0).astype(float), [bool(s > AMBIGUOUS) or not ok for s, ok in zip(second, lettered, strict=True)],
            )

        return work

    return map_texts(docs, make, ["text"], keep, FIELDS)
