"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most ``capacity``
entries) goes to the driver, where the plan is made: first sets of one to three pieces that provably dominate every other
set with the same piece are fixed, then the rest is placed best-fit, longest first. The plan speaks of the
r-th piece of a length; ranks are dealt within (length, salt) groups, so that no length has to fit one task.

Defined cases: a null or empty text is one piece holding the end token; a very long text is encoded whole and cut into
pieces; rows with equal doc_id, repeated ones included, are packed one by one; an empty table gives no piece; columns of
the input that bear the name of an added column are replaced by it.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framequarry.llm.common import BATCH_ROWS
from framequarry.session import materialise

CAPACITY = 2048
END_ID = 0
#: Groups that the pieces of one length are dealt to.
SALTS = 256
#: Entries of each word cache in a Python worker; a full cache starts anew.
CACHE_WORDS = 400_000

_PLAIN = regex.compile(r"[!-~À-ɏ]+")
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PIECE_FIELDS = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own, with words looked up in caches.

    Blanks and line feeds separate words for this vocabulary and are dropped, so a text is encoded word by word. A word of
    printable ASCII and Latin letters is cut by the vocabulary's own pattern; any other goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        spelt = "".join(map(self.letters.__getitem__, part.encode()))
        return np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in _PART.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= CACHE_WORDS:
                    self.parts.clear()
                ids = self._part(part)
                if len(part) <= 64:
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            pass
        known, out = self.words, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = self._word(word)
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, whose caches outlive a task."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, keep: list[str], capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: columns ``keep``, piece, start, length, ids_crc32, and ids (binary) if asked for."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    fields = [*PIECE_FIELDS, *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    keep = [c for c in keep if c not in {f.name for f in fields}]
    schema = T.StructType([*[docs.schema[c] for c in keep], *fields])
    width, end = capacity * 4, np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            row, out = [], [[] for _ in fields]
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row.append(i)
                    for column, value in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
            kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in keep]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


class Plan:
    """Where the r-th piece of each length goes: runs of (length, first rank) to (sequence, pieces a sequence, offset).

    ``reduce`` off gives plain best fit, longest first. ``plan`` makes both and takes the one of fewer sequences.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, reduce: bool = True):
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.given: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces a sequence, offset
        if reduce:
            self._reduce()
        self._best_fit()
        self.runs.sort()

    def _place(self, length: int, sequences: int, first: int, each: int, offset: int) -> None:
        self.runs.append((length, self.given[length], first, each, offset))
        self.given[length] += sequences * each
        self.left[length] -= sequences * each
        if not self.left[length]:
            del self.left[length]

    def _fix(self, chosen: list[int]) -> None:
        """Fix the set ``chosen`` of lengths as often as there are pieces for it."""
        times = min(self.left[n] // chosen.count(n) for n in set(chosen))
        at = 0
        for n in chosen:
            self._place(n, times, self.sequences, 1, at)
            at += n
        self.sequences += times
        self.fixed += times

    def _reduce(self) -> None:
        """Fix sets that dominate every other set with the same piece, until no piece has one.

        Such a set can be taken first without using more sequences than the best plan does: what else might share a
        sequence with that piece fits where the set's other pieces would have gone. As pieces only become fewer, a set that
        dominates once does so until its own pieces run out.
        """
        found = True
        while found:
            found = False
            for n in sorted(self.left, reverse=True):
                while n in self.left and (chosen := self._dominant(n)):
                    self._fix(chosen)
                    found = True

    def _dominant(self, own: int) -> list[int] | None:
        """The set of one to three pieces that dominates all others with a piece of length ``own``, if there is one."""
        free = self.capacity - own
        if free <= 0:
            return [own]
        if free in self.left and (free != own or self.left[own] > 1):
            return [own, free]  # full: whatever else were there fits into the other piece
        others = sorted(n for n, c in self.left.items() if n <= free and (n != own or c > 1))
        if not others:
            return [own]
        number = {n: self.left[n] - (n == own) for n in others}
        small = [n for n in others[:3] for _ in range(min(3, number[n]))][:3]
        largest = others[-1]
        if len(small) < 2 or small[0] + small[1] > free:
            return [own, largest]  # one other at most
        if len(small) == 3 and sum(small) <= free:
            return None  # three others may fit
        if self._best_pair(others, number, free) <= largest:
            return [own, largest]  # any two others that fit go where the largest one would
        below = [n for n in others if n <= free - largest and (n != largest or number[n] > 1)]
        if below:
            more = [n for n in others if n > below[-1]]
            pair = [n for n in more[:2] for _ in range(min(2, number[n]))][:2]
            if len(pair) < 2 or sum(pair) > free:
                return [own, largest, below[-1]]  # of two others one is at most the largest, one at most this
        return None

    @staticmethod
    def _best_pair(lengths: list[int], number: dict[int, int], free: int) -> int:
        """The largest sum of two pieces within ``free``, 0 if none."""
        best, i, j = 0, 0, len(lengths) - 1
        while i <= j:
            total = lengths[i] + lengths[j]
            if total > free:
                j -= 1
            else:
                if i < j or number[lengths[i]] > 1:
                    best = max(best, total)
                i += 1
        return best

    def _best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of (first sequence, number)
        sizes: list[int] = []

        def give(room: int, first: int, n: int) -> None:
            if room and n:
                if not rooms[room]:
                    bisect.insort(sizes, room)
                rooms[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect.bisect_left(sizes, length)
                if at == len(sizes):  # a new sequence for each capacity // length pieces
                    each = self.capacity // length
                    n = max(1, self.left[length] // each)
                    each = min(each, self.left[length])
                    self._place(length, n, self.sequences, each, 0)
                    give(self.capacity - each * length, self.sequences, n)
                    self.sequences += n
                    continue
                room = sizes[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    sizes.pop(at)
                each = min(room // length, self.left[length])
                used = min(n, self.left[length] // each)
                self._place(length, used, first, each, self.capacity - room)
                give(room - each * length, first, used)
                give(room, first + used, n - used)

    def arrays(self) -> tuple[np.ndarray, ...]:
        table = np.array(self.runs, np.int64).reshape(-1, 5)
        return tuple(table.T)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan of fewer sequences of those with and without the reduction; of equals the reduced one."""
    return min((Plan(counts, capacity), Plan(counts, capacity, reduce=False)), key=lambda p: p.sequences)


def pack(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, capacity: int = CAPACITY, with_ids: bool = False, salts: int = SALTS) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; sequences are numbered from 0 without gaps."""
    keep = ["doc_id"] if keep is None else [c for c in keep if c not in {"sequence_id", "offset"}]
    salt = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in keep], "piece", "ids_crc32"), F.lit(salts)).alias("salt")
    cut = materialise(pieces(docs, tokenizer_path, keep, capacity, with_ids).select("*", salt), "pieces")
    groups = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = materialise(groups.select("length", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "lengths")
    lengths = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(plan(lengths, capacity).arrays())
    order = Window.partitionBy("length", "salt").orderBy(*[F.col(c) for c in keep], "piece", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order)).join(groups.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", (F.col("rank") - 1 + F.col("before")).cast("long"))
    columns = [c for c in cut.columns if c != "salt"]
    schema = T.StructType([*[cut.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    wide = 1 << 44  # ranks of a length

    def run(batches):
        length, rank, first, each, offset = table.value
        starts = length * wide + rank
        for batch in batches:
            n, r = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, n * wide + r, "right") - 1
            r = r - rank[at]
            made = pa.array(first[at] + r // each[at]), pa.array(offset[at] + r % each[at] * n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=schema.names)

    return ranked.select(*columns, "rank").mapInArrow(run, schema)
