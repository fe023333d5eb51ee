"""Lempel-Ziv fingerprints against a plain parse."""

import hashlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from framequarry.llm import lzprint, queries


def plain(text):
    data = (text or "").encode()
    words = []
    for w in data.split(b" ") if data else []:
        words += [w[i : i + 8] for i in range(0, len(w), 8)] if len(w) > 24 else [w]
    phrases, open_ = set(), ()
    for w in words:
        open_ = (*open_, w)
        if open_ not in phrases:
            phrases.add(open_)
            open_ = ()
    best = [None] * 128
    for p in phrases:
        h = 0
        for w in p:
            h = xxh64_intdigest(w, h)
        if best[h >> 57] is None or h < best[h >> 57]:
            best[h >> 57] = h
    return bytes(0 if h is None else h % 255 + 1 for h in best)


def like(a, b):
    some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


def tie(text):
    """The order of rows with equal doc_id: Spark's hash of the text."""
    h = 42 if text is None else xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0], tie(d[1])))
    want = []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = plain(text), plain(edited), plain(after)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), like(a, b), like(a, c)))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_op1_equals_plain_parse(spark, sf):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    rows = queries.op1_lz_fingerprint(spark, sf).collect()
    check(rows, docs)
    longer = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in longer) > 0.95 * len(longer)


def test_odd_rows(spark, odd, empty):
    check(lzprint.edits(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert lzprint.edits(empty).count() == 0
    assert lzprint.fingerprints(odd).columns == [*odd.columns, "lz_fingerprint"]
    one = odd.filter("doc_id = 5").limit(1)
    assert lzprint.edits(one).first().near_next == 1.0


def test_one_doc_id_of_many_rows(spark):
    docs = [(7, f"text of row {i} " * 5) for i in range(200)] + [(i, f"row {i}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(lzprint.edits(df).collect(), docs)
    parts = lzprint._dealt(df, 8).select(F.spark_partition_id().alias("p"), "doc_id").filter("doc_id = 7").groupBy("p").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 80
