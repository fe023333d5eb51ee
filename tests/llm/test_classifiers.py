"""Held-out accuracy of the learned operators, and their odd rows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framequarry.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def held_out(doc_id, n, k):
    return zlib.crc32(str(doc_id).encode()) % n == k


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(y))
    s = np.array(score)[order]
    i = 0
    while i < len(s):
        j = np.searchsorted(s, s[i], "right")
        ranks[order[i:j]] = (i + j - 1) / 2 + 1
        i = j
    y = np.array(y)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def labelled(rows, name):
    marks = {r["doc_id"]: r[name] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = [(r, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    return auc([r.score for r, _ in got], [m for _, m in got]), np.mean([r.predicted == m for r, m in got])


def test_op4_held_out(spark):
    rows = queries.op4_toxicity(spark, SF).collect()
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    area, right = labelled(rows, "toxic")
    print("toxicity", area, right)
    assert area > 0.93 and right > 0.95


def test_op5_held_out(spark):
    rows = queries.op5_language_id(spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    right = np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out])
    print("language", right)
    assert right > 0.97


def test_op10_held_out(spark):
    rows = queries.op10_quality(spark, SF).collect()
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    area, right = labelled(rows, "quality")
    print("quality", area, right)
    assert area > 0.9 and right > 0.9


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"grob": toxicity.STRONG, "flau": toxicity.FEEBLE})
    e = g.evidence
    assert e("you are an idiot") == toxicity.AIMED and e("idiot, that is what you are") == pytest.approx(toxicity.AIMED + toxicity.ALONE)
    assert e("an idiot it seems was there long ago") == e("so grobian!") == toxicity.ALONE < 0.05
    assert 0 < e("you are not an idiot") == toxicity.NEGATED < e("she said you idiot") == toxicity.REPORTED < 1
    assert e("she said you are not an idiot") == pytest.approx(toxicity.NEGATED * toxicity.REPORTED)
    assert e("i will kill you") == toxicity.THREATENED > e("i will not kill you") > 0 == e("kill the process") == e("") == e("kill. you")
    assert e("an idiot came. a moron left") == pytest.approx(toxicity.ALONE + toxicity.PILED)
    assert e("an idiot came." + " a day passed." * 9 + " a moron left") == pytest.approx(2 * toxicity.ALONE)
    assert e("you flauer") == pytest.approx(toxicity.WEAK)
    assert e("an idiot but then a quite long word list before you") == toxicity.ALONE


def test_composition_equals_running_in_a_row():
    rng = np.random.default_rng(4)
    parts = [toxicity.Reports(), toxicity.Negations(), toxicity.Threats(), toxicity.Targets(), toxicity.Abuse()]
    machine = toxicity.Composition(parts)
    for _ in range(50):
        word = [str(s) for s in rng.choice(list("oijhtnr."), 60)]
        passed, total, at, path = word, 0.0, 0, 0.0
        for m in parts:  # the whole word through one transducer, then through the next
            state, out = m.start, []
            for s in passed:
                state, s, w = m.arc(state, s)
                out.append(s)
                total += w
            passed = out
        for s in word:
            at, w = machine.step(at, s)
            path += w
        assert path == pytest.approx(total)


def test_clauses_tell_more_than_words():
    """On held-out labels, and on texts that negate, report or only mention an insult."""
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    marks = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["toxic"] is not None and r["doc_id"] in texts}
    train, held = ([i for i in marks if held_out(i, 4, 2) == k] for k in (False, True))
    model = toxicity.ToxicityModel([texts[i] for i in train if marks[i] == 1], [texts[i] for i in train if marks[i] == 0])
    read = model.grammar.read
    words = {i: any(read(w) in (toxicity.STRONG, toxicity.FEEBLE) for w in toxicity.WORD.findall(texts[i].lower())) for i in held}
    clauses = {i: model.score(texts[i]) >= toxicity.THRESHOLD for i in held}
    false = lambda found: sum(found[i] for i in held if not marks[i])
    recall = lambda found: np.mean([found[i] for i in held if marks[i]])
    print("false alarms: words", false(words), "clauses", false(clauses), "recall", recall(words), recall(clauses))
    assert false(clauses) < false(words) / 5 and recall(clauses) > 0.9
    tame = ["he was no idiot at all", "they reported that a moron was seen", "the word stupid is old", "the clown made the children laugh", "she killed time", "he did not hurt them"]
    assert not any(model.score(t) >= toxicity.THRESHOLD for t in tame)
    assert all(model.score(t) >= toxicity.THRESHOLD for t in ["you are a stupid loser", "these people are scum. what trash", "i will hurt you badly", "pathetic idiots. worthless moron. a stupid clown"])


def test_prior_is_estimated():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.8):
        good, bad = rng.beta(8, 2, 40_000), rng.beta(2, 8, 40_000)
        n = int(40_000 * prior)
        levels = lambda x: np.bincount(np.minimum((x * 1000).astype(int), 999), minlength=1000)
        assert abs(quality.share_of_positives(levels(np.concatenate([good[:n], bad[n:]])), levels(rng.beta(8, 2, 4000))) - prior) < 0.08


def test_quality_weights_lower_the_plain_risk():
    """The weights' non-negative risk, written out plainly, is below that of no weights, and near the least found by small steps."""
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (300, 3)), np.concatenate([rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (300, 3))])
    edges = np.array([np.quantile(u[:, j], quality.CUTS) for j in range(3)])
    model = quality.QualityModel(edges).learn(p, u, 0.5)

    def risk(w):
        f = lambda x: np.array([sum(w[j * quality.BINS + np.searchsorted(edges[j], v)] for j, v in enumerate(row)) + w[-1] for row in x])
        loss = lambda m: np.log1p(np.exp(-m)).mean()
        return 0.5 * loss(f(p)) + max(0.0, loss(-f(u)) - 0.5 * loss(-f(p)))

    least = risk(model.weights)
    assert least < risk(np.zeros_like(model.weights)) - 0.2
    assert all(risk(model.weights * k) > least - 0.05 for k in (0.5, 0.8, 1.25, 2))
    score = model.score(np.concatenate([u[:300], u[300:]]))
    assert score[:300].mean() > 0.6 > 0.4 > score[300:].mean()


def test_decoding_equals_plain_codes():
    texts, langs = [b"the cat and the dog with the bird", b"le chat est avec un chien", b"der hund und die katze", b"el gato con un perro"] * 3, ["en", "fr", "de", "es"] * 3
    model = langid.LanguageModel(texts, langs)
    for text in (b"the dog", b"un chien et un chat", b"die katze", b"con el perro", b"zzz"):
        grams = langid.trigrams([text])[0]
        m = model.weights[grams].astype(float).mean(axis=0) * model.scale + model.shift
        loss = [sum(t * np.log1p(np.exp(-c * x)) for t, c, x in zip(model.trust, code, m, strict=True)) for code in model.code]
        best, score, second = model.decode([text])
        share = np.exp(min(loss) - np.array(loss))
        assert best[0] == int(np.argmin(loss)) and score[0] == pytest.approx(1 / share.sum(), rel=1e-4) and second[0] == pytest.approx(np.sort(share)[-2], rel=1e-4)


def test_letters_are_category_l(spark):
    texts = ["²", "½", "Ⅷ", "①", "_1", "ß", "日", "ª", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = spark.createDataFrame([("the cat", "en"), ("le chat", "fr")] * 5, "text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.fit(train)).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True, True, True, True, True, False, False, False, True]


def test_samples_dont_grow_with_repeats(spark):
    """A doc_id, a text or a language that many rows share brings no more than its bound to the driver."""
    rows = spark.range(3000).selectExpr("7L as doc_id", "if(id % 3 = 0, 'the same text', concat('text number ', id)) as text", "if(id < 2990, 'en', concat('l', id)) as lang")
    model = langid.fit(rows, per_language=30)
    assert len(model.langs) == 11
    labels = spark.createDataFrame([(7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    from framequarry.llm.common import distinct_sample, spread_sample

    assert 25 <= len({r.text for r in distinct_sample(rows, "text", 50)}) == len(distinct_sample(rows, "text", 50)) <= 50
    assert distinct_sample(rows, "text", 50) == distinct_sample(rows.repartition(5), "text", 50)
    spread = [r.text for r in spread_sample(rows, "text", 300)]
    assert 200 < len(spread) < 400 and 60 < spread.count("the same text") < 140
    assert toxicity.fit(rows, labels, texts=20).grammar is not None


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (5, 1, 1), (5, 1, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        model = toxicity.fit(odd, marks)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.toxicity_score <= 1 for r in rows)
        stats = quality.with_statistics(odd, ["doc_id", "text"])
        rows = quality.score(stats, quality.fit(stats, marks, F.lit(True)), ["doc_id"]).collect()
        assert len(rows) == odd.count() and all(0 <= r.quality_score <= 1 for r in rows)
    rows = langid.predict(odd, langid.fit(odd)).collect()
    assert {r.lang_pred for r in rows if not r.text or not any(c.isalpha() for c in r.text)} == {"und"} and {r.lang_pred for r in rows} == {"und", "en"}
    assert langid.predict(empty, langid.fit(empty)).count() == toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


def test_equal_texts_get_equal_languages():
    model = langid.LanguageModel([b"the cat and the dog with the bird", b"le chat est avec un chien", b"der hund und die katze"] * 3, ["en", "fr", "de"] * 3)
    alone = model.decode([b"the bird with the dog"])
    among = model.decode([b"x" * 50, b"the bird with the dog", b"", b"the bird with the dog"])
    assert model.langs[alone[0][0]] == model.langs[among[0][1]] == model.langs[among[0][3]] == "en" and np.allclose(among[1][[1, 3]], alone[1])


def test_codewords_lie_apart():
    for n in (1, 2, 3, 4, 7, 40, 200):
        rows = langid.codewords(n)
        assert len({tuple(r) for r in rows}) == n
