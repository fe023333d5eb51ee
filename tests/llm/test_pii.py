"""Personal data: base spans against plain patterns, what the method adds, redaction."""

import hashlib
import re

import pyarrow.parquet as pq

from framequarry.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, want.values()))
        joined = [f"{k}:{a}:{b}" for k, x in want.items() for a, b in x]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


def test_op2_equals_plain_patterns(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        rows = queries.op2_pii(spark, d).collect()
        texts = {x["doc_id"]: x["text"] for x in pq.read_table(f"{d}/documents.parquet").to_pylist()}
        check(rows, texts)
        assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    spare = [s for r in rows for s in r.spans.split(",") if s and s.startswith("secret")]
    assert spare


def test_hard_texts(spark):
    texts = [
        "a@b.c_d@e.f a@b.c..x@y.z @a.b x@y a@b.-c é@b.co aé@b.co.é", "1.2.3.4.5.6.7.8 256.1.1.1 0010.1.1.1 1.2.3 999.1.2.3.4 99999999999999999999.1.1.1 😀10.0.0.1",
        "4111 1111 1111 1111 5 4111-1111-1111-1111 4111  1111 1111 1111 4111111111111112 0000000000000 1 2 3 4 5 6 7 8 9 0 1 2 3",
        "+1 (017) 555-7713 +123456 +1.2.3.4.5.6.7.8.9 ++49 30 1234567) +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "x" * 200_000 + "@a.b", "1" * 6_000, "1 " * 50_000, "+1 " * 20_000, "a@b.cc " * 2000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df, ["doc_id"])
    for r in found.collect():
        got = {k: [(s.start, s.stop) for s in r.base if s.kind == k] for k in pii.KINDS[:4]}
        assert got == base(texts[r.doc_id])


def test_classifier_and_redaction(spark, odd, empty):
    rows = [(i, "call me on (555) 123-4567 now") for i in range(40)] + [(100 + i, "part 555-123-45678 isbn 555 123 4567") for i in range(10)]
    rows += [(200 + i, f'token = "{i:02d}' + "ab12" * 9 + '" and visit') for i in range(30)] + [(300, "mail j.doe [at] example [dot] com x"), (301, "naïve a@b.co, +1 (555) 555-1234"), (302, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[0] == "call me on [PHONE] now" and "[SECRET]" in got[200] and got[301] == "naïve [EMAIL], [PHONE]" and got[302] is None
    assert got[100] == rows[40][1]
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    mail = out.filter("doc_id = 12").first()
    assert mail.text == "mail me at [EMAIL] or [PHONE], [IP]" and mail.n_chars == len(mail.text)
    assert pii.redact(empty).count() == 0


def plain_em(spans, rounds=60):
    """Posteriors of spans (votes) by expectation-maximisation, span by span."""
    before = [(0.04, 0.36, 0.6), (0.1, 0.4, 0.5), (0.1, 0.4, 0.5), (0.2, 0.4, 0.4)]  # of a vote against, none and for, if it is personal data
    held = max(20.0, len(spans) / 10)
    right = [{v: before[j][v + 1] for v in (-1, 0, 1)} for j in range(4)]
    wrong = [{v: before[j][1 - v] for v in (-1, 0, 1)} for j in range(4)]
    share, p = 0.5, []
    for _ in range(rounds):
        p = []
        for votes in spans:
            a, b = share, 1 - share
            for j, v in enumerate(votes):
                a, b = a * right[j][v], b * wrong[j][v]
            p.append(a / (a + b))
        share = min(0.7, max(0.05, (sum(p) + 1) / (len(spans) + 2)))
        for j in range(4):
            for table, weight, side in ((right, p, 1), (wrong, [1 - x for x in p], -1)):
                seen = {v: held * before[j][side * v + 1] + sum(x for x, votes in zip(weight, spans, strict=True) if votes[j] == v) for v in (-1, 0, 1)}
                table[j] = {v: x / sum(seen.values()) for v, x in seen.items()}
    return p


def test_reliabilities_equal_plain_em():
    import random

    rng = random.Random(3)
    spans = []
    for _ in range(400):  # the second labeler says nothing true
        real = rng.random() < 0.4
        spans.append(tuple(rng.choice((-1, 0, 1)) if j == 1 else (1 if real else -1) if rng.random() < 0.8 else 0 for j in range(4)))
    counts = {}
    for v in spans:
        counts["phone", v, 0] = counts.get(("phone", v, 0), 0) + 1
    got = pii.SpanClassifier({})._em(counts, 60)
    for votes, p in zip(spans, plain_em(spans), strict=True):
        assert abs(got["phone", votes, 0] - p) < 1e-6


def test_long_secrets_and_spelt_mail_are_found(spark):
    texts = ["token: " + "a1" * 300 + " end", "write to " + "x" * 100 + " [at] " + "y" * 90 + " [dot] com now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.more] for r in pii.candidates(df, ["doc_id"]).collect()}
    assert more[0] == [("secret", 7, 607)] and more[1] == [("email", 9, 9 + 100 + 6 + 90 + 10)]
