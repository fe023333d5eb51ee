"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, a clause into words, and a lexicon turns each word into a symbol: strong or weak insult, threat,
target, negation, report, other; a full stop ends each clause. Five weighted transducers read the symbols, the output of
one being the input of the next:

* reports mark what follows a report in its clause as reported;
* negations mark the next insult or threat within REACH words as negated;
* threats weigh a threat that finds its target within REACH words;
* targets weigh an insult that stands within REACH words of a target, on either side, and pass on the others;
* abuse weighs what is left over: insults that follow an earlier one within SPAN clauses (a pile), or next to nothing.

They are composed into one machine, state by state as texts reach them. A text's evidence is the sum of the weights on its
path: so clauses that match a pattern count, and a word by itself doesn't. Evidence, squashed, is calibrated by a logistic
fit on labelled texts.

The base vocabulary is fixed; further insults are learned as word stems: the prefixes of words, of any length from STEM on,
that cover the most labelled toxic texts not covered yet, with next to no clean text.

Training takes at most ``TEXTS`` labelled texts of either kind (a documented bound on labelled rows), picked by a hash of the
text; everything else covers all rows and whole texts, however long.

Defined cases: null and empty texts have no clause and the score of no evidence; repeated rows are scored one by one and
equal texts alike; a doc_id with several labels is toxic if any says so, labels of null or unknown doc_ids say nothing;
without both labels the base vocabulary is used with a fixed calibration; an empty table gives no rows; a column
toxicity_score of the input is replaced by the operator's.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.llm.common import distinct_sample, map_texts, rows_of, without

TEXTS = 2500
THRESHOLD = 0.3
#: Learned stems: their least length, the least number of texts each adds; the least share of toxic texts among those that
#: hold a stem once, or twice and more.
STEM, ADDS = 4, 4
ONCE, TWICE = 0.95, 0.75

# The base vocabulary of each class.
INSULTS = "idiot moron stupid loser clown scum trash pathetic worthless disgusting dumb imbecile cretin bastard filth vermin idiota imbecil estupido basura escoria idiote imbecile ordure minable abruti idiotin dummkopf abschaum versager trottel"
THREATS = "kill hurt beat destroy stab shoot strangle punish crush burn matar golpear tuer frapper toten schlagen"
TARGETS = "you your yours he him she her they them this that these those people tu vous toi du dich ihr sie usted ustedes ellos"
NEGATIONS = "not no never neither nor isn aren wasn don doesn didn won pas jamais nicht kein keine nie nunca jamas"
REPORTS = "said says say called calls wrote claimed claims quoted reported according dit sagte schrieb dijo llamado"
WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;:\n]+")

#: Words within which a negation, a threat's target or an insult's target counts; clauses within which insults pile up.
REACH, SPAN = 4, 6
#: Weights: of an aimed insult, a threat with its target, an insult in a pile, one by itself.
AIMED, THREATENED, PILED, ALONE = 1.0, 1.0, 0.8, 0.02
#: What a weak insult, negation and reported speech leave of a weight.
WEAK, NEGATED, REPORTED = 0.4, 0.1, 0.2

OTHER, STRONG, FEEBLE, THREAT, TARGET, NEGATION, REPORT, STOP = "o", "i", "j", "h", "t", "n", "r", "."


def share(symbol: str) -> float:
    """What is left of a weight: the symbol of an insult or threat with its marks."""
    return (WEAK if symbol[0] == FEEBLE else 1.0) * (NEGATED if "-" in symbol else 1.0) * (REPORTED if "'" in symbol else 1.0)


def insult(symbol: str) -> bool:
    return symbol[0] in (STRONG, FEEBLE)


class Reports:
    """Insults and threats behind a report, to the end of its clause, get the mark '."""

    start = False

    def arc(self, opened: bool, symbol: str):
        if symbol == REPORT:
            return True, OTHER, 0.0
        if symbol == STOP:
            return False, STOP, 0.0
        return opened, symbol + "'" if opened and (insult(symbol) or symbol == THREAT) else symbol, 0.0


class Negations:
    """The next insult or threat within REACH words of a negation gets the mark - ; the state is the words left."""

    start = 0

    def arc(self, left: int, symbol: str):
        if symbol == NEGATION:
            return REACH, OTHER, 0.0
        if symbol == STOP:
            return 0, STOP, 0.0
        if left and (insult(symbol) or symbol[0] == THREAT):
            return 0, symbol + "-", 0.0
        return max(0, left - 1), symbol, 0.0


class Threats:
    """A threat followed by a target within REACH words; the state is the open threat and the words left to it."""

    start = None

    def arc(self, state, symbol: str):
        if symbol[0] == THREAT:
            return (symbol, REACH), OTHER, 0.0
        if symbol == STOP or state is None:
            return None, symbol, 0.0
        if symbol == TARGET:
            return None, symbol, THREATENED * share(state[0])
        return (state[0], state[1] - 1) if state[1] > 1 else None, symbol, 0.0


class Targets:
    """Insults within REACH words of a target; the state is the words left to the last target, and an insult still open."""

    start = (0, None)

    def arc(self, state, symbol: str):
        near, held = state
        if symbol == STOP:
            return self.start, STOP, 0.0
        if symbol == TARGET:
            return (REACH, None), OTHER, AIMED * share(held[0]) if held else 0.0
        if insult(symbol):
            if near:
                return (near - 1, None), "a" + symbol, AIMED * share(symbol)
            return (0, (symbol, REACH)), symbol, 0.0
        held = (held[0], held[1] - 1) if held and held[1] > 1 else None
        return (max(0, near - 1), held), symbol, 0.0


class Abuse:
    """Insults without a target: a pile if another insult stands within SPAN clauses before; the state is the clauses left."""

    start = 0

    def arc(self, left: int, symbol: str):
        if symbol == STOP:
            return max(0, left - 1), STOP, 0.0
        if symbol[0] == "a":
            return SPAN, OTHER, 0.0
        if insult(symbol):
            return SPAN, OTHER, (PILED if left else ALONE) * share(symbol)
        return left, OTHER, 0.0


class Composition:
    """One machine from transducers in a row; its states and arcs are made when a text first reaches them."""

    def __init__(self, machines: Iterable):
        self.machines = list(machines)
        self.states = [tuple(m.start for m in self.machines)]
        self.number = {self.states[0]: 0}
        self.arcs: list[dict[str, tuple[int, float]]] = [{}]

    def step(self, at: int, symbol: str) -> tuple[int, float]:
        """The next state and the weight of the arc."""
        known = self.arcs[at].get(symbol)
        if known is None:
            passed, total, states = symbol, 0.0, []
            for machine, state in zip(self.machines, self.states[at], strict=True):
                state, passed, weight = machine.arc(state, passed)
                states.append(state)
                total += weight
            to = self.number.setdefault(tuple(states), len(self.states))
            if to == len(self.states):
                self.states.append(tuple(states))
                self.arcs.append({})
            known = self.arcs[at][symbol] = to, total
        return known


class Grammar:
    """The lexicon and the composed machine."""

    def __init__(self, stems: dict[str, str] | None = None, machines: Iterable | None = None):
        """stems: prefixes of words to STRONG or FEEBLE."""
        self.stems = dict(stems or {})
        self.words = {w: k for k, text in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (STRONG, INSULTS)) for w in text.split()}
        self.heads = {w[:STEM] for w, k in self.words.items() if k in (STRONG, THREAT)} | {s[:STEM] for s in self.stems}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.machine = Composition(machines if machines is not None else (Reports(), Negations(), Threats(), Targets(), Abuse()))

    def read(self, word: str) -> str:
        """The symbol of a word; the longest stem decides."""
        if word[:STEM] in self.heads:
            for n in self.lengths:
                if len(word) >= n and (kind := self.stems.get(word[:n])):
                    return kind
        return self.words.get(word, OTHER)

    def evidence(self, text: str) -> float:
        """The summed weight of the path; clauses without a word of the lexicon's heads only pass the time."""
        low = text.lower()
        heads, read, step = self.heads, self.read, self.machine.step
        if not any(w[:STEM] in heads for w in set(WORD.findall(low))):
            return 0.0
        total, at = 0.0, 0
        for part in CLAUSE.split(low):
            words = WORD.findall(part)
            if any(w[:STEM] in heads for w in words):
                for word in words:
                    at, weight = step(at, read(word))
                    total += weight
            if words:
                at, weight = step(at, STOP)
                total += weight
        return total


def _frequent(texts: list[dict[str, int]], least: int) -> dict[str, set[int]]:
    """The prefixes of words that ADDS texts or more hold ``least`` times, with those texts; longer ones from shorter ones."""
    found: dict[str, set[int]] = {}
    size, words = STEM, [{w: n for w, n in t.items() if len(w) >= STEM and not w.isdigit()} for t in texts]
    while True:
        level: dict[str, set[int]] = defaultdict(set)
        for i, own in enumerate(words):
            counts: Counter[str] = Counter()
            for w, n in own.items():
                counts[w[:size]] += n
            for s, n in counts.items():
                if n >= least:
                    level[s].add(i)
        level = {s: x for s, x in level.items() if len(x) >= ADDS}
        if not level:
            return found
        found |= level
        words = [{w: n for w, n in own.items() if len(w) > size and w[:size] in level} for own in words]
        size += 1


def learn_stems(toxic: list[str], clean: list[str]) -> dict[str, str]:
    """Word stems to STRONG or FEEBLE, by greedy cover of the toxic texts.

    First come stems of which one occurrence tells, then, for the texts these leave, stems of which only a second one does.
    """
    toxic, clean = list(dict.fromkeys(toxic)), list(dict.fromkeys(clean))
    bad, good = ([Counter(WORD.findall(t.lower())) for t in x] for x in (toxic, clean))
    known = Grammar()
    left = {i for i, words in enumerate(bad) if not any(known.read(w) in (STRONG, THREAT) for w in words)}
    out: dict[str, str] = {}
    for least, least_share, kind in ((1, ONCE, STRONG), (2, TWICE, FEEBLE)):
        where = {s: x for s, x in _frequent(bad, least).items() if len(x & left) >= ADDS}
        lengths = sorted({len(s) for s in where})
        also: Counter[str] = Counter()
        for words in good:
            seen: Counter[str] = Counter()
            for w, n in words.items():
                for size in lengths:
                    if size > len(w):
                        break
                    if w[:size] in where:
                        seen[w[:size]] += n
            also.update(s for s, n in seen.items() if n >= least)
        pure = {s: x for s, x in where.items() if len(x) / (len(x) + also[s] + 0.5) >= least_share}
        while pure:
            # the stem that adds the most texts; of equals the purest, then the longest
            best = max(pure, key=lambda s: (len(pure[s] & left), -also[s], len(s), s))
            left -= pure.pop(best)
            out.setdefault(best, kind)
            pure = {s: x for s, x in pure.items() if len(x & left) >= ADDS}
    return out


class ToxicityModel:
    """A grammar with learned stems, and the calibration of its evidence."""

    def __init__(self, toxic: list[str], clean: list[str], machines: Iterable | None = None):
        self.grammar = Grammar(learn_stems(toxic, clean) if toxic and clean else {}, machines)
        self.slope, self.shift = 4.0, -2.5
        if toxic and clean:
            x = np.array([self._squash(self.grammar.evidence(t)) for t in [*toxic, *clean]])
            y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
            self.slope, self.shift = _calibrate(x, y)

    @staticmethod
    def _squash(evidence: float) -> float:
        return 1 - float(np.exp(-evidence))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self._squash(self.grammar.evidence(text)) + self.shift))))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and shift of a ridge logistic fit by Newton steps."""
    z, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.1), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, trained: Column | bool = True, texts: int = TEXTS) -> ToxicityModel:
    """A model of the labelled rows whose label's doc_id satisfies ``trained``, from at most ``texts`` distinct texts of a kind."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.lit(True) if trained is True else trained)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = {kind: rows_of(docs.select("doc_id", text), marks.filter(F.col("toxic") == kind).select("doc_id"), "doc_id", texts) for kind in (0, 1)}
    picked = {kind: sorted(r.text for r in distinct_sample(own, "text", texts)) for kind, own in rows.items()}
    return ToxicityModel(picked[1], picked[0])


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with toxicity_score."""
    docs = without(docs, ["toxicity_score"])
    keep = docs.columns if keep is None else [c for c in keep if c.lower() != "toxicity_score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        return lambda texts: (np.array([model.score(t or "") for t in texts.to_pylist()], float),)

    return map_texts(docs, make, ["text"], keep, [T.StructField("toxicity_score", T.DoubleType())])
