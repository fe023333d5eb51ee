"""The five stages against plain versions of their decisions, stage by stage, and as a whole."""

import hashlib

import corpus_pipeline
import pyarrow.parquet as pq
from test_jaccard import smallest_ids
from test_matching import check_packing, hits

from framequarry.llm import pii, toxicity


def test_stages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    kept = stages["toxicity"](spark, docs, sf)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in before.items() if model.score(r.text) < 0.3}

    one = stages["near_duplicates"](spark, docs, sf)
    assert sorted(r.doc_id for r in one.collect()) == smallest_ids([(i, r.text) for i, r in before.items()]) and one.columns == docs.columns

    clean = stages["decontamination"](spark, docs, sf)
    items = [(str(r["item_id"]), r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns
    for i, r in before.items():
        n, n_hit, _ = hits(r.text, items)
        assert (i in got) == (n_hit <= 0.5 * n)
        if i in got:
            assert (got[i].text == r.text) == (n_hit == 0) and got[i].n_chars == len(got[i].text) and (n_hit == 0 or hits(got[i].text, items)[1] == 0)

    red = stages["pii"](spark, docs, sf)
    found = pii.candidates(docs, ["doc_id"])
    spans = {r.doc_id: r.s for r in found.select("doc_id", pii.accepted(pii.fit(found)).alias("s")).collect()}
    assert red.columns == docs.columns
    for r in red.collect():
        text, at, out = before[r.doc_id].text, 0, []
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, s.stop, s.kind)):
            if s.start >= at:
                out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.stop)
        assert r.text == "".join([*out, text[at:]]) and r.n_chars == len(r.text)


def test_run_chains_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = corpus_pipeline.run(spark, sf).collect()
    n, least = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= least + 1


def test_stages_take_odd_rows(spark, odd, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(5, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([("b", "nothing of the kind here at all"), (None, None)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, empty):
            out = stage(spark, table, sf)
            assert name == "packing" or out.columns == table.columns
            n = out.count()
            assert n == 0 if table is empty else n > 5
    texts = [r.text for r in corpus_pipeline.STAGES[3][1](spark, odd, sf).collect()]
    assert None in texts and hashlib.sha256("".join(t or "" for t in texts).encode()).hexdigest()
