"""The near-duplicate stage against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from framequarry.llm import jaccard

STAGE = dict(corpus_pipeline.STAGES)["near_duplicates"]


def smallest_ids(rows):
    """The smallest doc_id of each component, from all pairs that share a shingle."""
    own = [jaccard.shingles((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(own[i] & own[j])
            if own[i] == own[j] or common >= 0.8 * (len(own[i]) + len(own[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def test_stage_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = smallest_ids([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in STAGE(spark, docs, sf).collect()) == want


def test_stage_links_chains_and_non_copies(spark, sf):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:k], *(f"v{k}x{i}" for i in range(200 - k))]) for k in range(100, 200, 4)]  # neighbours alike, ends not
    texts += [" ".join(words[:190]), " ".join(words[10:]), "a b c d e f", "a b c d e g", "short one", "Short  ONE", None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in STAGE(spark, docs, sf).collect()) == smallest_ids(rows)


def test_one_row_of_each_component(spark, odd):
    from framequarry.llm import simhash

    docs = odd.select("doc_id", "text")
    labels = simhash.near_duplicates(docs, labels=True).collect()
    kept = simhash.keep_representatives(docs).collect()
    assert len(kept) == len({r.component for r in labels})
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({r.component_id for r in labels if r.component_id is not None})
    assert [r.text for r in kept if r.doc_id is None] == ["no id"]
    # empty, a, Ω, the fox, the fox!, long, x, Japanese, mail, no id
    assert len(STAGE(spark, odd, "").collect()) == 10
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (1, "x y z"), (None, "p q"), (None, "p q")], "doc_id long, text string")
    for keep in (simhash.keep_representatives, jaccard.keep_representatives):
        assert sorted((r.doc_id or 0, r.text) for r in keep(same).collect()) == [(0, "p q"), (1, "a b c"), (1, "x y z")]


def test_signatures_give_links(spark, sf, monkeypatch):
    """the stage indexes SimHash fingerprints by one-wildcard signatures; what they link is verified."""
    from framequarry.llm import simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in range(0, 400, 20)] + ["a b c d e f", "g h i j k l"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.numbered_rows(docs)
    order = spark.sparkContext.broadcast(jaccard._order(rows))
    own = jaccard._sets(rows, order).withColumnRenamed("__row", "node")
    got = {tuple(r) for r in jaccard._signature_pairs(own).collect()}
    fp = {r.node: r.fp & (2**64 - 1) for r in own.collect()}
    assert fp == {r["__row"]: simhash.simhash(r.text.encode(), jaccard.SHINGLE) for r in rows.collect()}

    def joined(edges):
        at = {i: i for i in fp}
        for a, b in edges:
            x, y = at[a], at[b]
            at = {i: x if c == y else c for i, c in at.items()}
        return {frozenset(i for i in fp if at[i] == c) for c in at.values()}

    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert got and got <= set(near) and joined(got) == joined(near)

    calls, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "links", lambda fps: calls.append("links") or simhash.links(fps))
    monkeypatch.setattr(jaccard, "_verified", lambda *x: calls.append("verified") or verified(*x))
    assert sorted(r.doc_id for r in STAGE(spark, docs, sf).collect()) == smallest_ids(list(enumerate(texts)))
    assert calls[:2] == ["links", "verified"]


def test_meetings_dont_grow_with_ranges(spark):
    """near copies meet at hundreds of shingles, but the more ranges of hashes there are, the pairs aren't sent more often."""
    words, rng = [f"w{i}" for i in range(600)], random.Random(5)
    texts = [" ".join(["x" if i == at else w for i, w in enumerate(words)]) for at in rng.sample(range(600), 20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    order = spark.sparkContext.broadcast((np.zeros(0, np.int64),) * 3)  # nothing is known
    own = jaccard._sets(rows, order).withColumnRenamed("__row", "node").withColumn("component", F.col("node"))
    kept, counts = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            met = [tuple(r) for r in jaccard._meetings(own, order, jaccard._cross_pairs).collect()]
            assert len(set(met)) == 190  # of each two of them, none lost
            counts.append(len(met))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert counts[1] < 2 * counts[0]


def test_near_copies_meet_the_least_changed(spark, sf, monkeypatch):
    """copies that are like their model only are held against it wherever it stands, not against each other."""
    words, rng = [f"w{i}" for i in range(200)], random.Random(3)
    texts = []
    for k in range(30):
        at = rng.sample(range(5, 195, 10), 3)
        texts.append(" ".join(f"v{k}x{i}" if i in at else w for i, w in enumerate(words)))
    rows = list(enumerate([*texts, " ".join(words)]))  # the model has the highest number
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    looked_at, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *x: looked_at.append(pairs.count()) or verified(pairs, *x))
    assert [r.doc_id for r in STAGE(spark, docs, sf).collect()] == smallest_ids(rows) == [0]
    assert sum(looked_at) < 3 * len(rows)


def test_common_pairs_lose_no_pair(spark):
    """entries of one component aren't held against each other, other ones once, at the first hash they share."""
    prefix = np.arange(1, 6, dtype=np.int64)
    nodes = [(i, 100, 7 if i < 40 else i, bytearray((prefix if i != 41 else np.append(9, prefix[1:])).tobytes())) for i in range(43)]
    own = spark.createDataFrame(nodes, "node long, n long, component long, prefix binary").repartition(3)
    order = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64), prefix))
    found = sorted(tuple(r) for r in jaccard._common_pairs(jaccard._common(own, order)).collect())
    assert found == [(a, b) for a in range(43) for b in range(max(a + 1, 40), 43)]
