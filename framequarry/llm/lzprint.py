"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78: a phrase is the longest known one and one more symbol). Symbols are
the pieces between blanks, pieces of over 24 bytes in steps of 8. A phrase is known by its chained hash, the hash of
its last symbol seeded with that of the phrase before it. The fingerprint is the minimum-hash signature of the phrase
set: the hash range is cut into BINS bins, of each the smallest phrase hash leaves one byte (1 to 255; 0 if the bin is empty).
The likeness of two fingerprints is the share of equal bytes among the bins that are not empty in both.

Defined cases: null and empty texts have no phrases (all bins empty) and are alike (1.0); equal texts have equal
fingerprints; very long texts are parsed whole; rows of equal doc_id follow each other in the order of their texts' hashes, so
that they needn't share a task (rows that are equal as a whole do); null doc_ids come first; an empty table gives no rows;
other columns of the input aren't read by ``edits``, and lz_fingerprint is replaced by ``fingerprints``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from framequarry.llm.common import BATCH_ROWS, map_texts, utf8

BINS = 128
_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(57)


def symbols(data: bytes) -> list[bytes]:
    words = data.split(b" ")
    if max(map(len, words)) > 24:
        words = [w[i : i + 8] if len(w) > 24 else w for w in words for i in (range(0, len(w), 8) if len(w) > 24 else (0,))]
    return words


def parse(words: Iterable[bytes], seen: set[int], at: int = 0) -> int:
    """Add the phrases of ``words`` to ``seen``; the hash of the phrase still open."""
    add = seen.add
    for word in words:
        h = xxh64_intdigest(word, at)
        if h in seen:
            at = h
        else:
            add(h)
            at = 0
    return at


def signature(seen: set[int]) -> bytes:
    if not seen:
        return bytes(BINS)
    h = np.fromiter(seen, np.uint64, len(seen))
    h.sort()
    first = np.searchsorted(h, _STARTS)
    least = h[np.minimum(first, len(h) - 1)]
    there = (first < len(h)) & (least >> np.uint64(57) == _STARTS >> np.uint64(57))
    return np.where(there, least % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    some = (x | y) != 0
    n = int(some.sum())
    return int(((x == y) & some).sum()) / n if n else 1.0


def fingerprint(text: str | bytes | None) -> bytes:
    seen: set[int] = set()
    data = text.encode() if isinstance(text, str) else text or b""
    if data:
        parse(symbols(data), seen)
    return signature(seen)


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and lz_fingerprint, the signature as lowercase hex."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "lz_fingerprint"]
    return map_texts(docs, lambda: lambda texts: ([fingerprint(t).hex() for t in utf8(texts)],), ["text"], keep, [T.StructField("lz_fingerprint", T.StringType())])


class _Document:
    """A parsed text, with the state of its parse where its last quarter begins."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.quarter = len(text) // 4
        data = text.encode()
        self.kept = text[: len(text) - self.quarter].encode()
        self.cut = self.kept.rfind(b" ") + 1  # the symbols before here are those of the edited text, too
        self.before: set[int] = set()
        self.at = parse(symbols(data[: self.cut - 1]), self.before) if self.cut else 0
        self.print = self._print(data)

    def _print(self, data: bytes) -> bytes:
        """The fingerprint of a text that begins as this one does."""
        seen = set(self.before)
        if data:
            parse(symbols(data[self.cut :]), seen, self.at)
        return signature(seen)

    def edited(self, after: _Document) -> tuple[bytes, bytes]:
        """The text whose last quarter is replaced by the first characters of ``after``; its fingerprint."""
        data = self.kept + after.text[: self.quarter].encode()
        return data, self._print(data)

    def row(self, after: _Document) -> tuple:
        data, other = self.edited(after)
        return self.doc_id, len(self.text), hashlib.sha256(data).hexdigest(), self.print.hex(), other.hex(), likeness(self.print, other), likeness(self.print, after.print)


EDIT_FIELDS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def _dealt(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows (doc_id, text, guest) in ranges of doc_id, each followed by the first row of the next (guest).

    The ranges are cut at quantiles of all doc_ids; a doc_id that several quantiles fall on is cut into as many ranges by the
    hash of the text. The text is shuffled once; what the driver sees is one key a range.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    key, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(least)), F.xxhash64("text")
    rows = docs.select(key.alias("key"), tie.alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [i / partitions for i in range(1, partitions)] or [0.5]
    times = Counter(rows.agg(F.percentile_approx("key", shares, 10_000)).first()[0] or [])
    cuts = sorted((k, least + (j << 64) // n) for k, n in times.items() for j in range(n))
    place = F.struct("key", "tie")
    bucket = F.size(F.filter(F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(t).cast("long").alias("tie")) for k, t in cuts]), lambda c: c <= place)) if cuts else F.lit(0)
    firsts = sorted((r.bucket, tuple(r.first)) for r in rows.select(place.alias("place"), bucket.alias("bucket")).groupBy("bucket").agg(F.min("place").alias("first")).collect())
    guests = spark.createDataFrame([(*first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "key long, tie long, host int")
    sent = rows.withColumn("bucket", bucket).join(F.broadcast(guests), ["key", "tie"], "left")
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("to"), F.lit(1).alias("guest")))))
    sent = sent.select("key", "tie", "doc_id", "text", F.explode(places).alias("p")).select("key", "tie", "doc_id", "text", "p.to", "p.guest")
    return sent.repartitionById(len(cuts) + 1, "to").sortWithinPartitions("guest", "key", "tie", "text").select("doc_id", "text", "guest")


def edits(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document, in the order of doc_id (the last's next is the first)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        last: _Document | None = None
        over = False
        for batch in batches:
            made = []
            for doc_id, text, guest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if over:
                    break
                now = _Document(doc_id, text or "")
                if last is not None:
                    made.append(last.row(now))
                last, over = now, bool(guest)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=EDIT_FIELDS.names)

    return _dealt(docs, partitions).mapInArrow(run, EDIT_FIELDS)
