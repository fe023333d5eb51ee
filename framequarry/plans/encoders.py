"""Pluggable text and image encoders; two that need no model files."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.functions.batches import release, text_lots, text_sizes


class TextEncoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class ImageEncoder(Protocol):
    def encode_images(self, images: list[bytes]) -> np.ndarray: ...


class Instructed:
    """An encoder that puts an instruction before queries, and none before documents."""

    def __init__(self, inner: TextEncoder, instruction: str):
        self.inner, self.instruction = inner, instruction

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.inner.encode(texts)

    def encode_query(self, texts: list[str]) -> np.ndarray:
        return self.inner.encode([f"{self.instruction}{t}" for t in texts])


def query_vectors(encoder: TextEncoder, texts: list[str]) -> np.ndarray:
    """The vectors of queries: by the encoder's own way if it has one."""
    return getattr(encoder, "encode_query", encoder.encode)(texts)


def gram_codes(texts: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all character n-grams of the texts (white space collapsed), and the number of the text each is from."""
    plain = [" ".join((t or "").split()) for t in texts]
    points = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), [len(t) for t in plain])
    codes, owners = [], []
    value = points * _MIX[0]
    for n in range(2, high + 1):
        if len(points) < n:
            break
        value = (value[:-1] ^ (value[:-1] >> np.uint64(29))) * _MIX[1] + points[n - 1 :]
        if n >= low:
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            final = (value[inside] ^ (value[inside] >> np.uint64(32))) * _MIX[2]
            codes.append(final ^ (final >> np.uint64(29)))
            owners.append(owner[n - 1 :][inside])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: Characters that are turned into n-grams at once.
AT_ONCE = 1 << 16


def _lots(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in lots of about AT_ONCE characters, each with the number of its first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class HashEncoder:
    """Character n-grams hashed with signs into a unit vector: deterministic, the same on every machine."""

    def __init__(self, dim: int = 64, low: int = 2, high: int = 4):
        self.dim, self.low, self.high = dim, low, high

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for first, lot in _lots(texts):
            codes, owner = gram_codes(lot, self.low, self.high)
            at = owner * self.dim + (codes % np.uint64(self.dim)).astype(np.int64)
            sign = np.where(codes >> np.uint64(63), 1.0, -1.0)
            out[first : first + len(lot)] = np.bincount(at, sign, len(lot) * self.dim).reshape(len(lot), self.dim)
        return _unit(out)


class SvdEncoder:
    """Character n-gram TF-IDF (sublinear tf, smoothed idf) projected on its leading singular vectors.

    N-grams are known by their 64-bit hashes; ``vocabulary`` holds them sorted.
    """

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, components: np.ndarray):
        self.vocabulary, self.idf, self.components = vocabulary, idf, components

    @classmethod
    def fit(cls, docs: DataFrame, text: str, dim: int = 64, features: int = 20_000, rows: int = 2000, seed: int = 42) -> SvdEncoder:
        """The vocabulary and idf come from all documents; the projection from a sample of at most about ``rows`` of them."""
        grams = docs.select(F.explode(_gram_udf(F.col(text))).alias("g"))
        n = docs.count()
        top = grams.groupBy("g").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "g").limit(features).toArrow()
        codes, df = top.column("g").to_numpy().view(np.uint64), top.column("df").to_numpy()
        by = np.argsort(codes)
        sample = docs.filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < min(1.0, rows / max(1, n)) * (1 << 30)).select(text).orderBy(F.xxhash64(text)).limit(2 * rows).collect()
        own = cls(codes[by], np.log((1 + n) / (1 + df[by].astype(float))) + 1, np.zeros((0, len(by))))
        matrix = own._tfidf([r[0] for r in sample])
        k = min(max(2, dim), max(1, matrix.shape[0] - 1), max(1, matrix.shape[1] - 1))
        rng = np.random.default_rng(seed)
        basis = np.linalg.qr(matrix.T @ rng.standard_normal((matrix.shape[0], min(k + 8, matrix.shape[0]))))[0]
        for _ in range(3):
            basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
        _, _, vt = np.linalg.svd(matrix @ basis, full_matrices=False)
        own.components = (vt @ basis.T)[:k]
        return own

    def _tfidf(self, texts: list[str]) -> np.ndarray:
        width = len(self.vocabulary)
        out = np.zeros((len(texts), width))
        for first, lot in _lots(texts):
            codes, owner = gram_codes(lot, 2, 4)
            at = np.minimum(np.searchsorted(self.vocabulary, codes), max(0, width - 1))
            known = self.vocabulary[at] == codes if width else np.zeros(len(codes), bool)
            cell, count = np.unique(owner[known] * width + at[known], return_counts=True)
            out[first + cell // max(1, width), cell % max(1, width)] = (1 + np.log(count)) * self.idf[cell % max(1, width)]
        return _unit(out)

    def encode(self, texts: list[str]) -> np.ndarray:
        parts = [self._tfidf(texts[i : i + 256]) @ self.components.T for i in range(0, len(texts), 256)]
        return _unit(np.vstack(parts) if parts else np.zeros((0, len(self.components))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _gram_udf(texts: pd.Series) -> pd.Series:
    """The distinct n-grams of each text."""
    return texts.map(lambda t: np.unique(gram_codes([t], 2, 4)[0]).view(np.int64))


#: Encoders by the name of their backend.
BACKENDS: dict[str, Callable[..., TextEncoder]] = {"hash": HashEncoder, "local-svd": SvdEncoder}


def load_encoder(backend: str, **given) -> TextEncoder:
    if backend not in BACKENDS:
        raise ValueError(f"unknown encoder backend: {backend}")
    return BACKENDS[backend](**given)


def save_encoder(encoder: HashEncoder | SvdEncoder, folder: str) -> None:
    """Arrays and a manifest (backend, model, dim) in a folder; ``restore_encoder`` reads them."""
    os.makedirs(folder, exist_ok=True)
    if isinstance(encoder, SvdEncoder):
        np.savez(os.path.join(folder, "arrays.npz"), vocabulary=encoder.vocabulary, idf=encoder.idf, components=encoder.components)
        manifest = {"backend": "local-svd", "dim": len(encoder.components)}
    else:
        manifest = {"backend": "hash", "dim": encoder.dim, "low": encoder.low, "high": encoder.high}
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2)


def restore_encoder(folder: str) -> TextEncoder:
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    if manifest["backend"] == "hash":
        return HashEncoder(manifest["dim"], manifest["low"], manifest["high"])
    if manifest["backend"] != "local-svd":
        raise ValueError(f"unknown encoder backend: {manifest['backend']}")
    with np.load(os.path.join(folder, "arrays.npz")) as a:
        return SvdEncoder(a["vocabulary"], a["idf"], a["components"])


def encode_column(text: Column | str, encoder: TextEncoder) -> Column:
    """A vector for each text, in Arrow batches and of a few texts at a time; blank texts have none."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def encode(texts: pa.Array) -> pa.Array:
        made = [np.zeros(0)]
        lengths, blank = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        for first, stop in text_lots(text_sizes(texts)):
            lot = texts.slice(first, stop - first).to_pylist()
            filled = [i for i, t in enumerate(lot) if t and not t.isspace()]
            if filled:
                vectors = np.asarray(encoder.encode([lot[i] for i in filled]), np.float64)
                at = first + np.array(filled)
                lengths[at], blank[at] = vectors.shape[1], False
                made.append(vectors.ravel())
        release()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made)), mask=pa.array(blank))

    return encode(text)


def caption_rows(rows: DataFrame, describe: Callable[[dict], str], columns: list[str], key: str, attempts: int = 1, wait: float = 0.0, longest: float = 30.0) -> DataFrame:
    """(key, answer, error) of a captioning callable for each row, tried ``attempts`` times; failures become error rows.

    Before the n-th further attempt ``wait`` * 2 ** (n - 1) seconds pass, ``longest`` at most.
    """
    schema = T.StructType([rows.schema[key], T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        for own in batches:
            answers, errors = [], []
            for record in own.to_dict("records"):
                answer = error = None
                for n in range(max(1, attempts)):
                    if n and wait:
                        time.sleep(min(longest, wait * 2 ** (n - 1)))
                    try:
                        answer, error = describe(record), None
                        break
                    except Exception as e:  # the callable is the user's: whatever it raises is the row's error
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({key: own[key], "answer": answers, "error": errors})

    return rows.select(*dict.fromkeys([key, *columns])).mapInPandas(run, schema)
