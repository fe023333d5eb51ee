"""Benchmark decontamination by a generalised suffix automaton over word sequences.

All benchmark items go into one automaton (word ids as symbols). A document's words are streamed through it; the
automaton always knows the longest suffix of what was read that occurs in some item. Where that suffix is at least as
long as a window (``window`` words, or all words of a shorter item), the last words are a hit.

An automaton holds at most about BLOCK_WORDS words, so what is broadcast is bounded; a larger benchmark is streamed block by
block, each with its own pass over the texts.

Defined cases: a null or wordless text has no words, hits or items; a null or wordless item has no window; items
with equal texts are all reported; very long texts are read whole; rows with equal doc_id are treated one by one; an empty
table gives no rows, and an empty benchmark no hits; extra columns pass through
``decontaminate`` and are replaced where they bear the name of an added column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.llm.common import map_texts, utf8, without
from framequarry.session import materialise

WINDOW = 10
#: Words of benchmark items in one automaton; more items make more automata, each broadcast and streamed by itself.
BLOCK_WORDS = 500_000
#: Above this share of hit words the whole document goes; below it only the hit spans do.
MAX_COVERAGE = 0.5

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; states are numbers, the root is 0."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        known = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, seq in known:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self._windows(known, window)

    def _add(self, size: int, step: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of (at + word) with exactly size(at) + 1 words, cut off a larger one if need be."""
        old = self.step[at][word]
        if self.size[old] == self.size[at] + 1:
            return old
        cut = self._add(self.size[at] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = cut
        while at >= 0 and self.step[at].get(word) == old:
            self.step[at][word] = cut
            at = self.link[at]
        return cut

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._add(self.size[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def _windows(self, known: list[tuple[str, list[int]]], window: int) -> None:
        """ends[state]: (words of the window, items) for each window that ends wherever the state is reached."""
        own: dict[int, dict[int, set[str]]] = {}
        for name, seq in known:
            width, at = min(window, len(seq)), 0
            for i, word in enumerate(seq):
                at = self.step[at][word]  # of the item's first i + 1 words
                if i + 1 >= width:
                    while self.size[self.link[at]] >= width:
                        at = self.link[at]
                    own.setdefault(at, {}).setdefault(width, set()).add(name)
        self.ends: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.size)
        for at in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            mine = sorted((n, frozenset(x)) for n, x in own.get(at, {}).items())
            above = self.ends[self.link[at]]
            self.ends[at] = (*above, *mine) if mine else above
        self.least = [x[0][0] if x else 1 << 60 for x in self.ends]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The merged hit spans (first word, stop) of a document, and the items whose windows occur in it."""
        step, link, size, least, ends = self.step, self.link, self.size, self.least, self.ends
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        at = have = 0
        for i, word in enumerate(map(self.ids.get, words)):
            if word is None:
                at = have = 0
                continue
            to = step[at].get(word)
            while to is None and at:
                at = link[at]
                have = size[at]
                to = step[at].get(word)
            if to is None:
                have = 0
                continue
            at, have = to, have + 1
            if have >= least[at]:
                width = 0
                for n, names in ends[at]:
                    if n <= have:
                        width = max(width, n)
                        items |= names
                first = i + 1 - width
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return spans, items


def blocks(benchmark: DataFrame, words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items in blocks of about ``words`` words, one block at a time on the driver."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        found = words_of((row.text or "").encode())
        block.append((row.i or "", found))
        n += len(found)
        if n >= words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, stop in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((first, stop))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns ``keep`` of docs with n_words, hit_spans (word numbers, stop exclusive) and hit_items (sorted)."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    added = [f.name for f in _FIELDS]
    carried = [c for c in keep if c.lower() not in added]
    docs = without(docs, added)
    waiting = blocks(benchmark, block_words)
    block, following = next(waiting, []), next(waiting, None)
    out, first = docs, True
    while True:
        last = following is None
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))

        def make(shared=shared, first=first):
            automaton = shared.value

            def work(texts: pa.Array, *before: pa.Array):
                n, spans, items = [], [], []
                for text in utf8(texts):
                    words = words_of(text)
                    s, names = automaton.scan(words)
                    n.append(len(words))
                    spans.append(s)
                    items.append(names)
                if not first:
                    spans = [_merged([*s, *((x["first"], x["stop"]) for x in old)]) for s, old in zip(spans, before[1].to_pylist(), strict=True)]
                    items = [s | set(old) for s, old in zip(items, before[2].to_pylist(), strict=True)]
                return n, [[{"first": a, "stop": b} for a, b in s] for s in spans], [sorted(s) for s in items]

            return work

        given = ["text"] if first else ["text", *added]
        out = map_texts(out, make, given, carried if last else list(dict.fromkeys([*carried, "text"])), _FIELDS)
        if last:
            return out
        # written, so that only one block's automaton is held at a time
        out = materialise(out, "scanned")
        shared.destroy()
        block, following, first = following, next(waiting, None), False


def _cut(text: str, spans: list[dict]) -> str:
    """The text without the characters from the first to the last of each span's words."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data.translate(_NORMAL))]
    out, done = [], 0
    for s in spans:
        out.append(data[done : at[s["first"]][0]])
        done = at[s["stop"] - 1][1]
    return b"".join([*out, data[done:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents with their hit spans cut out of ``text``; those of a greater coverage than ``max_coverage`` go.

    ``n_chars``, if there, follows the new text. Documents without a hit stay as they are.
    """
    columns = docs.columns
    found = scan(without(docs, [f.name for f in _FIELDS]), benchmark, window, keep=[c for c in columns if c not in {f.name for f in _FIELDS}])
    hit = F.coalesce(F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["first"]), F.lit(0))
    found = found.withColumn("__hit", hit).filter(F.col("__hit") <= F.col("n_words") * F.lit(float(max_coverage)))

    def make():
        def work(texts: pa.Array, spans: pa.Array):
            return ([_cut(t, s) if s and t is not None else t for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)],)

        return work

    kept = [c for c in columns if c not in {"text"}]
    out = map_texts(found, make, ["text", "hit_spans"], [*kept, "__hit"], [T.StructField("text", T.StringType())])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__hit") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)
