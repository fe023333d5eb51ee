"""Removal of repeated byte strings by a sparse suffix array, sorted with a common-prefix-aware distributed merge.

A byte goes if a string of ``MIN_BYTES`` bytes that covers it also starts anywhere else. Sorting the suffixes at all
positions isn't needed: of each such string the position of its least-hashed inner gram of ``GRAM`` bytes is chosen (an
anchor), which two equal strings choose alike. So equal strings meet as suffixes at equal anchors, with equal bytes
before them.

1. Anchors of every whole text: about two in REACH + 1 positions. Those whose gram occurs once can't matter and go.
2. The bytes around an anchor that strings through it can touch are its context. A context that occurs twice is repeated
   as a whole. Contexts that share their gram with others are told apart by sorting: each task sorts its suffixes (the context
   from the anchor on) and front-codes them into runs, one for each range of grams; runs are exchanged and merged by
   loser trees that never compare a known prefix again (``lcp``). The prefixes shared by neighbours give the classes of
   contexts equal so far to the right, those of the reversed bytes before the anchor the ones equal to the left; two strings
   are equal if both agree.
3. A gram with more than ``CROWD`` different contexts would crowd one task. Its strings are counted by their
   hashes instead, which spreads them over all tasks: the same result.

Grams and contexts are known by pairs of 64-bit hashes. Defined cases: null and empty texts, and those of fewer bytes
than ``MIN_BYTES``, have nothing removed; very long texts are read whole; copies of a row count as other occurrences; rows of
equal doc_id stay apart; an empty table gives no rows; columns k1, k2, z and spans of the input come back as nulls.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.llm.common import BATCH_ROWS, map_texts, utf8, without
from framequarry.llm.lcp import LoserTree, decode, front_code, shared
from framequarry.session import discard, materialise

MIN_BYTES = 400
GRAM = 256
REACH = MIN_BYTES - GRAM
CROWD = 4096
#: Suffixes in a run, and members resolved at once.
RUN, LOT = 20_000, 4096
SPLITTERS_FROM = 20_000

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    if len(_POWERS[0]) <= n:
        for i, b in enumerate((_BASE, _UNBASE)):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * n, b, np.uint64))])
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _extreme(x: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """The least or greatest of each w consecutive values."""
    n = -(-len(x) // w) * w
    padded = np.full(n, fill, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = f.accumulate(rows, axis=1).ravel()
    behind = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: len(x) - w + 1], ahead[w - 1 : len(x)])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes, context hashes, and the bytes each context has behind its gram."""
    size = len(data)
    if size < MIN_BYTES:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    up, down = _powers(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * up[:size], out=sums[1:])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: size - GRAM + 1])
    least = _extreme(grams, REACH + 1, np.minimum, 2**64 - 1)
    # an anchor is the least gram of some string: the greatest of the minima around it is its own hash
    around = np.zeros(len(least) + 2 * REACH, np.uint64)
    around[REACH : REACH + len(least)] = least
    at = np.flatnonzero(_extreme(around, REACH + 1, np.maximum, 0) == grams)
    before, behind = np.minimum(at, REACH), np.minimum(size - GRAM - at, REACH)
    low, high = at - before, at + GRAM + behind
    context = (sums[high] - sums[low]) * down[low] + (before * 1_000_003 + behind).astype(np.uint64) * np.uint64(_BASE)
    return at, grams[at].view(np.int64), _mixed(context).view(np.int64), behind


_KEYS = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
_ANCHORS = T.StructType([*_KEYS, T.StructField("pos", T.IntegerType()), T.StructField("behind", T.ShortType()), T.StructField("g", T.LongType()), T.StructField("u", T.LongType())])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key: doc_id (a number for null) and a hash of the text; copies of a row share it."""
    docs = without(docs, ["k1", "k2", "z", "spans"])
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "k2": F.xxhash64("text", F.col("doc_id").isNull())})


def _packed(keyed: DataFrame) -> DataFrame:
    """The rows with their text compressed (z), for the two joins that must shuffle it."""

    def make():
        from zstandard import ZstdCompressor

        compress = ZstdCompressor(level=6, write_content_size=True).compress
        return lambda texts: ([None if t is None else compress(t.encode()) for t in texts.to_pylist()],)

    return map_texts(keyed, make, ["text"], [c for c in keyed.columns if c != "text"], [T.StructField("z", T.BinaryType())])


def _unpacked(column: pa.Array) -> list[bytes]:
    from zstandard import ZstdDecompressor

    expand = ZstdDecompressor().decompress
    return [b"" if z is None else expand(z) for z in column.to_pylist()]


def _all_anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            made = [anchors(t) for t in utf8(batch.column("text"))]
            counts = [len(m[0]) for m in made]
            at, g, u, behind = (np.concatenate([m[i] for m in made]) for i in range(4))
            k1, k2 = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((k1, pa.int64()), (k2, pa.int64()), (at.astype(np.int32), pa.int32()), (behind.astype(np.int16), pa.int16()), (g, pa.int64()), (u, pa.int64()))], names=_ANCHORS.names)

    return docs.select("k1", "k2", "text").mapInArrow(run, _ANCHORS)


_CONTEXTS = T.StructType([T.StructField("g", T.LongType()), T.StructField("u", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()), T.StructField("before", T.BinaryType()), T.StructField("suffix", T.BinaryType())])


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts, (g, u, n, m, k1, k2, pos): those before the anchor, and the suffix from it on."""
    by_doc = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "u", "n", "m", "pos")).alias("at"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in _CONTEXTS]
            for data, places in zip(_unpacked(batch.column("z")), batch.column("at").to_pylist(), strict=True):
                for p in places:
                    at = p["pos"]
                    for column, value in zip(out, (p["g"], p["u"], p["n"], p["m"], data[max(0, at - REACH) : at], data[at : at + MIN_BYTES]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.binary(), pa.binary()), strict=True)], names=_CONTEXTS.names)

    return _packed(docs.select("k1", "k2", "text")).join(by_doc, ["k1", "k2"]).select("z", "at").mapInArrow(run, _CONTEXTS)


_PAYLOAD = "<qqq"
_FOUND = T.StructType([T.StructField("g", T.LongType()), T.StructField("u", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))])


def _resolve(members: list[tuple[int, int, int, int, bytes, bytes, int]]) -> list[tuple[int, int, list[dict]]]:
    """Which strings through each member's anchor occur elsewhere.

    members: (class, g, u, n, before, suffix, prefix shared with the member before), in suffix order. A string begins
    ``o`` bytes before the anchor, 0 to REACH; its class is that of the o bytes before and the MIN_BYTES - o bytes behind.
    """
    m = len(members)
    group = np.array([x[0] for x in members])
    weight = np.array([x[3] for x in members], float)
    before, behind = np.array([len(x[4]) for x in members]), np.array([len(x[5]) for x in members])
    right = np.array([0, *(x[6] for x in members[1:])])
    backward = [x[4][::-1] for x in members]
    order = sorted(range(m), key=lambda i: (group[i], backward[i]))
    left = np.array([-1, *(shared(backward[a], backward[b]) if group[a] == group[b] else -1 for a, b in zip(order, order[1:], strict=False))])
    hit = np.zeros((m, REACH + 1), bool)
    order = np.array(order)
    for o in range(REACH + 1):
        r = np.cumsum(right < MIN_BYTES - o)
        lo = np.empty(m, np.int64)
        lo[order] = np.cumsum(left < o)
        valid = (before >= o) & (behind >= MIN_BYTES - o)
        if valid.any():
            _, inverse = np.unique(r[valid] * (m + 1) + lo[valid], return_inverse=True)
            hit[valid, o] = np.bincount(inverse, weight[valid])[inverse] > 1.5
    # contexts that occur twice are repeated as a whole anyway
    return [(x[1], x[2], _runs(np.flatnonzero(h))) for x, h in zip(members, hit, strict=True) if x[3] == 1 and h.any()]


def _runs(values: np.ndarray) -> list[dict]:
    cuts = np.flatnonzero(np.diff(values) != 1) + 1
    return [{"first": int(p[0]), "last": int(p[-1])} for p in np.split(values, cuts)]


def _sorted_contexts(contexts: DataFrame, partitions: int) -> DataFrame:
    """(g, u, runs) of those contexts (g, u, n, before, suffix) that occur once and whose gram has others: sort, front-code, exchange and merge."""
    n = max(1, contexts.count())
    sample = contexts.filter(F.pmod("u", F.lit(1 << 20)) < min(1.0, SPLITTERS_FROM / n) * (1 << 20)).select(F.expr(f"substring(suffix, 1, {GRAM})").alias("s")).limit(2 * SPLITTERS_FROM)
    grams = sorted(bytes(r.s) for r in sample.collect())
    splitters = sorted({grams[i * len(grams) // partitions] for i in range(1, partitions)}) if grams else []
    shared_splitters = contexts.sparkSession.sparkContext.broadcast(splitters)
    runs = T.StructType([T.StructField("target", T.IntegerType()), T.StructField("block", T.BinaryType())])

    def sort(batches):
        splitters, held = shared_splitters.value, []

        def flush():
            held.sort()
            parts: dict[int, list] = defaultdict(list)
            for row in held:
                parts[bisect.bisect_right(splitters, row[0][:GRAM])].append(row)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([front_code(x) for x in parts.values()], pa.binary())], names=runs.names)

        for batch in batches:
            held += [(s, struct.pack(_PAYLOAD, g, u, n) + b) for g, u, n, b, s in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)]
            if len(held) >= RUN:
                yield flush()
        if held:
            yield flush()

    def merge(batches):
        blocks = [b for batch in batches for b in batch.column(1).to_pylist()]
        lot: list[tuple] = []
        number, seen = 0, set()

        def done():
            found = _resolve(lot)
            lot.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))))], names=_FOUND.names)

        least = 0  # of what rows left out share, too
        for suffix, common, payload in LoserTree([decode(b) for b in blocks]):
            least = min(least, common)
            if common < GRAM:
                if len(lot) >= LOT:
                    yield done()
                number, seen, least = number + 1, set(), common
            g, u, n = struct.unpack_from(_PAYLOAD, payload)
            if u in seen:  # the same context again, from a copy of its row
                continue
            seen.add(u)
            lot.append((number, g, u, n, payload[24:], suffix, least))
            least = len(suffix)
        if lot:
            yield done()

    return contexts.mapInArrow(sort, runs).repartitionById(len(splitters) + 1, "target").mapInArrow(merge, _FOUND)


_STRINGS = T.StructType([T.StructField("g", T.LongType()), T.StructField("u", T.LongType()), T.StructField("n", T.LongType()), T.StructField("o", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def _counted_contexts(contexts: DataFrame) -> DataFrame:
    """(g, u, runs) as from sorting, by counting the hashes of all strings through the anchors."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in _STRINGS]
            for g, u, n, before, suffix in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                data = before + suffix
                for o in range(max(0, MIN_BYTES - len(suffix)), len(before) + 1):
                    at = len(before) - o
                    h = xxhash.xxh3_128_digest(data[at : at + MIN_BYTES])
                    for column, value in zip(out, (g, u, n, o, *struct.unpack("<qq", h)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=_STRINGS.names)

    strings = materialise(contexts.dropDuplicates(["g", "u"]).mapInArrow(run, _STRINGS), "strings")
    repeated = materialise(strings.groupBy("o", "h1", "h2").agg(F.sum("n").alias("times")).filter("times > 1").select("o", "h1", "h2"), "repeated-strings")
    kept = strings.filter("n = 1").join(repeated, ["o", "h1", "h2"], "left_semi").groupBy("g", "u").agg(F.collect_set("o").alias("os"))
    return kept.select("g", "u", F.transform(F.array_sort("os"), lambda o: F.struct(o.alias("first"), o.alias("last"))).alias("runs"))


def repeated_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, spans): for each row's key the byte spans that repeated strings cover (overlapping, unsorted)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    everywhere = materialise(_all_anchors(docs), "anchors")
    # sides of joins are written first where a key can be hot: Spark splits only keys that come straight from an exchange
    again = materialise(everywhere.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "grams")
    found = materialise(everywhere.join(again, "g", "left_semi"), "repeated")
    discard(everywhere)
    groups = materialise(found.groupBy("g", "u").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at")), "contexts")
    classes = materialise(groups.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"), "classes")
    contexts = materialise(_contexts(docs, groups.join(classes, "g").select("g", "u", "n", "m", "at.*")), "suffixes")
    columns = ["g", "u", "n", "before", "suffix"]
    parts = _sorted_contexts(contexts.filter(F.col("m") <= crowd).select(*columns), partitions)
    crowded = contexts.filter(F.col("m") > crowd).select(*columns)
    if crowded.limit(1).count():
        parts = parts.union(materialise(_counted_contexts(crowded), "counted"))
    whole = groups.filter("n > 1").select("g", "u", F.lit(None).cast(_FOUND["runs"].dataType).alias("runs"))
    results = materialise(whole.union(parts.select("g", "u", "runs")), "results")
    discard(contexts)
    hit = found.join(results, ["g", "u"])
    everything = F.array(F.struct((F.col("pos") - F.least("pos", F.lit(REACH))).alias("start"), (F.col("pos") + GRAM + F.col("behind")).cast("int").alias("stop")))
    single = F.transform("runs", lambda r: F.struct((F.col("pos") - r["last"]).alias("start"), (F.col("pos") - r["first"] + MIN_BYTES).alias("stop")))
    spans = hit.select("k1", "k2", F.explode(F.when(F.col("runs").isNull(), everything).otherwise(single)).alias("s"))
    return materialise(spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")), "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def _joined(docs: DataFrame, crowd: int) -> DataFrame:
    keyed = _keyed(docs)
    return _packed(keyed).join(repeated_spans(keyed.select("k1", "k2", "text"), crowd), ["k1", "k2"], "left")


def digests(docs: DataFrame, keep: list[str], crowd: int = CROWD) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_removed, n_spans and the hash of the bytes that remain."""

    def make():
        def work(packed: pa.Array, spans: pa.Array):
            rows = []
            for data, own in zip(_unpacked(packed), spans.to_pylist(), strict=True):
                cut = merged(own)
                kept, at = hashlib.sha256(), 0
                for start, stop in cut:
                    kept.update(data[at:start])
                    at = stop
                kept.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in cut), len(cut), kept.hexdigest()))
            return tuple(zip(*rows, strict=True))

        return work

    keep = [c for c in keep if c not in {f.name for f in FIELDS}]
    return map_texts(_joined(docs.select(*dict.fromkeys(["doc_id", "text", *keep])), crowd), make, ["z", "spans"], keep, FIELDS)


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Documents without the repeated bytes in ``text`` (a character cut in two goes as a whole); null texts stay null."""
    columns = docs.columns

    def make():
        def work(packed: pa.Array, spans: pa.Array):
            out = []
            for data, own, there in zip(_unpacked(packed), spans.to_pylist(), packed.is_valid().to_pylist(), strict=True):
                parts, at = [], 0
                for start, stop in merged(own):
                    parts.append(data[at:start])
                    at = stop
                out.append(None if not there else b"".join([*parts, data[at:]]).decode(errors="ignore"))
            return (out,)

        return work

    kept = [c for c in without(docs, ["k1", "k2", "z", "spans"]).columns if c != "text"]
    out = map_texts(_joined(docs, crowd), make, ["z", "spans"], kept, [T.StructField("text", T.StringType())])
    for c in columns:
        if c not in out.columns:  # a clashing name of the input can't pass through
            out = out.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    return out.select(*columns)


