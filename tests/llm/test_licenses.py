"""Licence scans against the model applied paragraph by paragraph."""

import math
import re

import pyarrow.parquet as pq

from framequarry.llm import licenses, queries


def plain(model, text):
    own, out = licenses.templates(), []
    lines = [x for x in re.split(r"[\r\n]+", text or "") if x.strip(" ")]
    for i, line in enumerate(lines):
        words = re.findall("[a-z0-9]+", line.lower())
        found = licenses.grams(words)
        margins = model.margins(found)
        top = max(margins)
        family = licenses.FAMILIES[margins.index(top)]
        cover = max(sum(p in found for p in t) / len(t) for t in own[family])
        if 1 / (1 + math.exp(-(top - model.least) * model.slope)) >= 0.5 and cover >= licenses.CONFIRMED:
            out.append((i, family))
    return len(lines), out


def test_op8_equals_plain_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = licenses.fit(docs)
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    for r in licenses.scan(docs, model, keep=["doc_id"]).collect():
        assert (r.n_paragraphs, [(x.paragraph, x.family) for x in r.licenses]) == plain(model, texts[r.doc_id])


def test_finds_known_lines(spark):
    known = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Released under the MIT License.": "mit"}
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op8_licenses(spark, d).collect()}
    n = 0
    for doc in pq.read_table(f"{d}/documents.parquet").to_pylist():
        want = sorted({known[x] for x in doc["text"].split("\n") if x in known})
        assert rows[doc["doc_id"]].families == ",".join(want)
        n += len(want)
    assert n > 10


def test_notices_and_odd_rows(spark, odd, empty):
    model = licenses.LicenseModel(["the cat is under the table", "a good day to all"] * 20)
    rows = [(i * 100 + j, n.upper() if j % 2 else n, f) for i, f in enumerate(licenses.FAMILIES) for j, n in enumerate(licenses.NOTICES[f])]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: [x.family for x in r.licenses] for r in licenses.scan(df, model).collect()}
    assert sum(got[i] == [f] for i, _, f in rows) >= len(rows) - 2
    out = licenses.scan(odd.withColumnRenamed("source", "licenses"), model)
    assert out.count() == odd.count() and all(not r.licenses for r in out.collect())
    assert licenses.scan(empty, licenses.fit(empty)).count() == 0


def test_wrapped_notices(spark):
    import textwrap

    model = licenses.LicenseModel(["the cat is under the table", "a good day to all"] * 20)
    long = [(f, n) for f in licenses.FAMILIES for n in licenses.NOTICES[f] if len(n) > 100]
    wrap = lambda n: "\n".join(textwrap.wrap(n, 30))
    prose = "the cat is under the table\na good day to all"
    rows = [(i, f"{prose}\n{wrap(n)}\n{prose}", [f]) for i, (f, n) in enumerate(long)]
    own, mit = wrap(dict(long)["proprietary"]), "Released under the MIT License"
    rows += [(100, own.replace("\n", "\r\n"), ["proprietary"]), (101, f"{mit}\n{own}", ["mit", "proprietary"]), (102, f"{wrap(long[0][1])}\n\n{own}\n{mit}", [long[0][0], "proprietary", "mit"]), (103, own.replace("\n", "\n\n"), [])]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    found = {i: {x.family for x in got[i].licenses} for i, *_ in rows}
    assert all(set(f) <= found[i] if i < 100 else set(f) == found[i] for i, _, f in rows)
    assert got[100].n_paragraphs == len(own.split("\n"))
