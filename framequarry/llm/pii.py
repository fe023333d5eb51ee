"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are what the base patterns match (those that pass their checks are base spans and always stay) and what
looser patterns match: phones without a plus, mail addresses spelt out, secrets after their names, card numbers that fail
their checksum. Four labelers vote -1, 0 or 1 on each candidate: its pattern and check, a gazetteer (mail domains'
endings, calling codes, issuers' digits), cue words before it, and what it borders on. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is for each kind, without labels. The posteriors then
train a logistic span classifier over votes, kind and length, which is applied to every candidate that isn't a base span.

The driver sees the counts of vote patterns only: at most kinds x 3^4 x 3 lengths rows. Positions are code points.

Defined cases: a null text is empty and stays null when redacted; very long texts are searched whole, by patterns of linear
time; an empty table gives no rows; without candidates nothing is learned and nothing added; equal rows are treated one
by one; added columns win over clashing ones.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.common import without
from framequarry.session import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
ACCEPT = 0.95
#: Characters before a candidate in which cue words count.
CONTEXT = 40

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Possessive forms of the base patterns: the same matches, found in linear time.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# What the method adds candidates from.
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
LOOSE_EMAIL = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?[\[(]dot[\])] ?[a-z0-9-]++)++"
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{24,}+(?![0-9A-Za-z])"

# Gazetteers and cue words.
ENDINGS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be se no fi dk pl pt br mx ca au nz jp cn in ru"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CUES = {
    "email": "mail email contact write reach address courriel correo", "ip": "ip host address server from client login adresse", "card": "card visa mastercard amex credit debit payment carte karte tarjeta",
    "phone": "phone call tel telephone mobile cell fax dial contact text telefon telefono", "secret": "token key secret password passwd api auth bearer credential",
}
AGAINST = {"email": "example regex format", "ip": "version release section chapter build v", "card": "isbn order invoice serial article part hash id", "phone": "isbn order invoice serial version id part", "secret": "commit sha md5 checksum hash digest revision"}

SPAN = "struct<kind:string,start:int,stop:int,value:string,before:string,base:boolean>"


def _matches(text: Column, pattern: str, when: Column, kind: str, base: Column | None = None, keep=None) -> Column:
    """An array of SPAN for each match, left to right; ``keep`` filters, ``base`` marks by the matched value."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("skip"), F.char_length(m).alias("size"), F.right(g, F.lit(CONTEXT)).alias("before")))
    empty = F.array().cast("array<struct<start:int,stop:int,value:string,before:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("stop"), x["m"].alias("value"), x["before"].alias("before"))
        return F.struct((start + x["size"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]
    if keep is not None:
        placed = F.filter(placed, keep)
    marked = F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), s["before"].alias("before"), (F.lit(base is None) if base is None else base(s)).alias("base")))
    return F.when(when, marked).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: F.struct(i.alias("i"), F.substring(digits, i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x["i"] % 2 == 1, x["d"]).otherwise((x["d"] * 2) % 10 + (x["d"] * 2 / 10).cast("int")))
    return total % 10 == 0


def _ip_ok(s: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$")


def _overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _cue(words: str) -> str:
    return rf"(?i)\b(?:{words.replace(' ', '|')})\b"


def _by_kind(s: Column, of: dict[str, Column], other: Column) -> Column:
    out = None
    for kind, value in of.items():
        out = F.when(s["kind"] == kind, value) if out is None else out.when(s["kind"] == kind, value)
    return other if out is None else out.otherwise(other)


def _labelled(s: Column, text: Column) -> Column:
    """The candidate with its votes and length class."""
    value, digits = s["value"], _digits(s["value"])
    pattern = F.when(s["base"], 1).otherwise(_by_kind(s, {"card": F.lit(-1), "secret": _vote(value.rlike("[a-f]") & value.rlike("[0-9]"), F.lit(True))}, F.lit(0)))
    places = {
        "email": _vote(F.lower(value).rlike(rf"[.\])] ?(?:{ENDINGS.replace(' ', '|')})$"), F.lit(False)),
        "ip": _vote(F.lit(False), value.rlike(r"^(?:0|255)\.|^(?:[0-9]\.){3}[0-9]$")),
        "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), F.lit(True)),
        "phone": _vote(F.when(value.startswith("+"), digits.rlike(rf"^(?:{CALLING.replace(' ', '|')})")).otherwise(False), value.startswith("+") | digits.rlike("^[01]")),
    }
    cue = _by_kind(s, {k: _vote(s["before"].rlike(_cue(CUES[k])), s["before"].rlike(_cue(AGAINST[k]))) for k in KINDS}, F.lit(0))
    after = F.substring(text, s["stop"] + 1, F.lit(1))
    border = F.when(s["before"].rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]"), -1).when(s["before"].rlike(r"(?:^|[\s:=\"'(<])$") & after.rlike(r"^(?:$|[\s.,;!?)>\"'])"), 1).otherwise(0)
    size = F.when(s["stop"] - s["start"] < 14, 0).when(s["stop"] - s["start"] < 24, 1).otherwise(2)
    return F.struct(*[s[n].alias(n) for n in ("kind", "start", "stop", "base")], F.array(pattern, _by_kind(s, places, F.lit(0)), cue, border).alias("votes"), size.alias("size"))


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, base and more: arrays of struct(kind, start, stop, base, votes, size), by kind, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"))
    t = F.col("__text")
    n = lambda s: F.char_length(_digits(s["value"]))
    many = t.rlike("[0-9](?:[ -]?[0-9]){12}")
    d = d.withColumn("__email", _matches(t, EMAIL, t.contains("@"), "email")).withColumn("__ip", _matches(t, IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "ip", keep=_ip_ok))
    d = d.withColumn("__cards", _matches(t, CARD, many, "card", base=lambda s: _luhn(s["value"]), keep=lambda s: n(s).between(13, 19)))
    d = d.withColumn("__phone", _matches(t, PHONE, t.contains("+"), "phone", keep=lambda s: n(s).between(9, 15)))
    base = F.concat("__email", "__ip", F.filter("__cards", lambda s: s["base"]), "__phone")
    loose = F.concat(
        F.filter("__cards", lambda s: ~s["base"]), _matches(t, LOOSE_PHONE, t.rlike("[0-9]{3}[ .-][0-9]{4}"), "phone", base=lambda s: F.lit(False)),
        _matches(t, LOOSE_EMAIL, t.rlike(r"(?i)[\[(]at[\])]"), "email", base=lambda s: F.lit(False)), _matches(t, SECRET, t.rlike("[0-9a-f]{24}"), "secret", base=lambda s: F.lit(False)),
    )
    d = d.withColumn("__base", base).withColumn("__loose", loose)
    d = d.withColumn("base", F.transform("__base", lambda s: _labelled(s, t))).withColumn("more", F.transform(F.filter("__loose", lambda s: ~_overlaps(s, F.col("__base"))), lambda s: _labelled(s, t)))
    return d.select(*keep, "base", "more")


class SpanClassifier:
    """EM over vote patterns, then a logistic classifier trained on the posteriors."""

    def __init__(self, counts: dict[tuple, int], rounds: int = 60):
        """counts: (kind, votes as a tuple, size) to spans."""
        self.weights: dict[str, float] = {}
        posterior = {}
        for kind in KINDS:
            own = {k: n for k, n in counts.items() if k[0] == kind}
            if own:
                posterior |= self._em(own, rounds)
        if counts:
            self._fit(counts, posterior)

    def _em(self, counts: dict[tuple, int], rounds: int) -> dict[tuple, float]:
        total = sum(counts.values())
        share = 0.5
        # what a vote means beforehand: patterns and checks err least; held with a tenth of the data's weight, which
        # settles which of the two classes is which and leaves the reliabilities to the data
        means = [{True: dict(zip((-1, 0, 1), v, strict=True)), False: dict(zip((1, 0, -1), v, strict=True))} for v in ((0.04, 0.36, 0.6), (0.1, 0.4, 0.5), (0.1, 0.4, 0.5), (0.2, 0.4, 0.4))]
        table, held = [dict(x) for x in means], max(20.0, total / 10)
        p: dict[tuple, float] = {}
        for _ in range(rounds):
            for k in counts:
                yes, no = math.log(share), math.log(1 - share)
                for j, v in enumerate(k[1]):
                    yes, no = yes + math.log(table[j][True][v]), no + math.log(table[j][False][v])
                p[k] = 1 / (1 + math.exp(min(60, max(-60, no - yes))))
            share = min(0.7, max(0.05, (sum(n * p[k] for k, n in counts.items()) + 1) / (total + 2)))
            for j in range(4):
                for c in (True, False):
                    seen = {v: held * x for v, x in means[j][c].items()}
                    for k, n in counts.items():
                        seen[k[1][j]] += n * (p[k] if c else 1 - p[k])
                    s = sum(seen.values())
                    table[j][c] = {v: x / s for v, x in seen.items()}
        return p

    @staticmethod
    def features(kind: str, votes: tuple[int, ...], size: int) -> list[str]:
        return ["", f"kind={kind}", f"size={size}", *(f"{kind}:{j}={v}" for j, v in enumerate(votes)), *(f"{j}={v}" for j, v in enumerate(votes))]

    def _fit(self, counts: dict[tuple, int], posterior: dict[tuple, float], rounds: int = 300) -> None:
        """Weighted ridge logistic regression by gradient steps; a pattern weighs the root of its count."""
        w: dict[str, float] = defaultdict(float)
        rows = [(self.features(*k), posterior[k], math.sqrt(n)) for k, n in sorted(counts.items())]
        total = sum(r[2] for r in rows)
        for _ in range(rounds):
            g: dict[str, float] = defaultdict(float)
            for f, y, n in rows:
                e = n * (y - 1 / (1 + math.exp(-min(30, max(-30, sum(w[x] for x in f))))))
                for x in f:
                    g[x] += e
            for x, v in g.items():
                w[x] += 1.0 * (v / total - 0.0005 * w[x])
        self.weights = dict(w)

    def probability(self, s: Column) -> Column:
        if not self.weights:
            return F.lit(0.0)
        table = F.create_map(*[F.lit(x) for kv in sorted(self.weights.items()) for x in kv])
        names = [F.lit(""), F.concat(F.lit("kind="), s["kind"]), F.concat(F.lit("size="), s["size"])]
        for j in range(4):
            v = s["votes"][j].cast("string")
            names += [F.concat(s["kind"], F.lit(f":{j}="), v), F.concat(F.lit(f"{j}="), v)]
        total = F.aggregate(F.array(*names), F.lit(0.0), lambda a, x: a + F.coalesce(F.element_at(table, x), F.lit(0.0)))
        return 1 / (1 + F.exp(-total))


def fit(found: DataFrame) -> SpanClassifier:
    """Learn from all rows of ``candidates``."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s")).select("s.kind", "s.votes", "s.size")
    return SpanClassifier({(r.kind, tuple(r.votes), r.size): r["count"] for r in spans.groupBy("kind", "votes", "size").count().collect()})


def accepted(model: SpanClassifier, least: float = ACCEPT) -> Column:
    """Of a row of ``candidates``: base spans and the others that the classifier accepts, by kind as listed, then start."""
    slim = lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    more = F.filter("more", lambda s: model.probability(s) >= least)
    return F.array_sort(F.concat(F.transform("base", slim), F.transform(more, slim)))


def count(kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """Documents with each span of ``text`` replaced by its kind in brackets; n_chars, if there, follows the new text."""
    columns = docs.columns
    plain = without(docs, ["base", "more"])
    found = candidates(plain, plain.columns)
    if model is None:  # the patterns run over the texts once; what they find is written and read twice
        found = materialise(found, "candidates")
        model = fit(found)
    by_start = F.array_sort(F.transform(accepted(model), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    text = F.col("text")

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["out"], F.when(fresh, piece).otherwise("")).alias("out"))

    folded = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    new = F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.char_length(text)))
    out = found.withColumn("__spans", by_start).withColumn("__hit", F.size("__spans") > 0).withColumn("text", F.when(F.col("__hit"), new).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__hit"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    for c in ("base", "more"):  # columns of these names of the input can't pass through; they come back as nulls
        if c in columns:
            out = out.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    return out.select(*columns)
