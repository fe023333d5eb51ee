"""Repeated strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq

from framequarry.llm import lcp, queries, suffixdedup


def plain(texts, n=400):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if counts[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, crowd=suffixdedup.CROWD):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffixdedup.digests(df, ["doc_id"], crowd).collect()), key=str)
    want = sorted([(i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]), strict=True)], key=str)
    assert got == want
    return sum(x[2] for x in want)


def planted(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [prose(n) for n in (380, 399, 400, 401, 430, 500, 900)]
    rows = []
    for i in range(60):
        t = prose(rng.randint(0, 700))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, 40), len(p) - rng.randint(0, 40)))
            t += p[a:b] + prose(rng.randint(0, 300))
        rows.append((i, t))
    rows += [(100, rows[5][1]), (101, rows[5][1][:600] + "x" + rows[5][1][600:]), (102, "ab" * 900), (103, "z" * 399), (104, "z" * 401), (105, None), (106, ""), (None, rows[7][1]), (8, rows[8][1]), (8, rows[8][1])]
    return rows


def test_equals_plain_count(spark):
    for seed in (1, 2):
        assert check(spark, planted(seed)) > 5000


def test_crowded_grams_are_counted_alike(spark):
    assert check(spark, planted(3), crowd=3) > 5000


def test_op6_on_documents(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_suffix_dedup(spark, sf).collect()}
    assert got == {d["doc_id"]: x for d, x in zip(docs, plain([d["text"] for d in docs]), strict=True)}


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 100]
    check(spark, rows)
    out = suffixdedup.remove_repeats(odd.withColumnRenamed("fp", "k1"))
    assert out.columns[5] == "k1" and out.count() == odd.count() and {r.text for r in out.filter("doc_id in (8, 9)").collect()} == {""}
    assert suffixdedup.digests(empty, ["doc_id"]).count() == 0


def test_loser_tree_keeps_order_and_prefixes():
    rng = random.Random(4)
    rows = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), bytes([i % 256])) for i in range(500)]
    for n in (1, 2, 3, 7, 16):
        blocks = [lcp.front_code(sorted(rows[i::n])) for i in range(n)]
        got = list(lcp.LoserTree([lcp.decode(b) for b in blocks]))
        assert [x[0] for x in got] == sorted(r[0] for r in rows)
        assert [x[1] for x in got[1:]] == [lcp.shared(a[0], b[0]) for a, b in zip(got, got[1:], strict=False)]
        assert sorted((x[0], x[2]) for x in got) == sorted(rows)
    assert list(lcp.LoserTree([])) == []
