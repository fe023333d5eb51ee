"""Near-duplicates by SimHash signatures, verified and completed by the exact Jaccard similarity of word shingles.

Two texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of at least 0.8; components
are the connected ones. Texts of equal sets are one node.

1. SimHash fingerprints of the shingles are indexed under one-wildcard signatures (``simhash.links``); the candidates of at
   most 2 bits are verified by their shingles.
2. A fingerprint of 64 bits is about 10 bits off at 0.8, and segments short enough for that many are shared by nearly all
   texts. So what the signatures miss comes from prefixes, exactly: in any one order of all shingles, two sets of similarity
   0.8 share one of their first n - ceil(0.8 n) + 1. No pair is lost, whatever the order; rare shingles come first (counts
   of a bounded sample, then the hash), so that few sets meet. One node of each shingle is compared with the others, and then
   those of different components that still meet in pairs, so a group of copies isn't turned into pairs. That one is the node
   that has the shingle earliest in its prefix, so the fewest shingles of its own: among near copies of a text the least changed.

Prefixes are exchanged as packed blocks, one for each range of hashes, where nodes with equal hashes meet. A meeting counts only if
the sizes and the places in both orders let the rest of the sets be similar, and where the first shingles are equal, only there.
Pairs then have to pass a bitmap of each set, which bounds the overlap, before their texts are compared. Hashes that the
sample shows to be common (HOT of its texts) don't take part in blocks, so that none of them fills a task; their entries are
joined as rows, which Spark splits where they are many: each entry outside the largest component of its hash with all the others.

Defined cases: null and wordless texts have the empty set, all equal; a text of up to five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.llm.common import hashed_sample, map_texts, release, utf8
from framequarry.llm.graph import components
from framequarry.llm.simhash import links, numbered_rows, one_row_each, simhash
from framequarry.session import discard, materialise

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Texts whose shingles are counted for the order, and the shingles it knows at most; neither changes the result.
ORDER_TEXTS = 6000
ORDER_SHINGLES = 200_000
#: Bits of the bitmap that bounds the overlap of two sets.
BITMAP = 2048
#: Row numbers (of 8 bytes) that are broadcast at most.
BROADCAST_IDS = 500_000
#: The share of the sample's texts from which a shingle is common.
HOT = 0.002
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes, shingle: int = SHINGLE) -> set[bytes]:
    words = text.translate(_LOWER).split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    common = len(a & b)
    return common * LEAST[1] >= (len(a) + len(b) - common) * LEAST[0]


def _hashes(text: bytes) -> np.ndarray:
    found = shingles(text)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).view(np.int64))


def _dealt(rows: np.ndarray, targets: int) -> pa.RecordBatch:
    """Entries by ranges of their hash (h), packed: (to, block)."""
    to = ((rows["h"].view(np.uint64) >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int64)
    rows = rows[np.argsort(to, kind="stable")]
    cuts = np.searchsorted(np.sort(to), np.arange(targets + 1))
    some = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())], names=_SENT.names)


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join([b for batch in batches for b in batch.column(1).to_pylist()]), kind)


_SENT = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("block", T.BinaryType())])
_SEEN = np.dtype([("h", "<i8"), ("set", "<i8")])


def _order(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that several different texts of a bounded sample hold, sorted, how many do, and the common ones."""
    targets = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = max(1, rows.count())

    def deal(batches):
        for batch in batches:
            each = [_hashes(t) for t in utf8(batch.column(0))]
            out = np.empty(sum(map(len, each)), _SEEN)
            out["h"] = np.concatenate(each) if each else 0
            out["set"] = np.repeat(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in each], np.uint64).view(np.int64), [len(h) for h in each])
            yield _dealt(out, targets)

    def count(batches):
        found = _gathered(batches, _SEEN)
        found = found[np.lexsort((found["set"], found["h"]))]
        if len(found):
            copy = (found["h"][1:] == found["h"][:-1]) & (found["set"][1:] == found["set"][:-1])
            h, c = np.unique(found["h"][np.append(True, ~copy)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[c > 1]), pa.array(c[c > 1])], names=["h", "c"])

    part = hashed_sample(rows, "__row", min(1.0, ORDER_TEXTS / total)).select("text")
    counted = part.mapInArrow(deal, _SENT).repartitionById(targets, "to").mapInArrow(count, "h long, c long")
    found = counted.orderBy(F.desc("c"), "h").limit(ORDER_SHINGLES).toArrow()
    h, c = (found.column(x).to_numpy() for x in ("h", "c"))
    by = np.argsort(h)
    h, c = h[by], c[by]
    return h, c, h[c >= max(3, HOT * min(total, ORDER_TEXTS))]


def _bitmap(h: np.ndarray) -> bytes:
    """For each of BITMAP residues whether an odd number of hashes has it; two sets differ in as many elements as bits, at least."""
    return np.packbits((np.bincount(h & (BITMAP - 1), minlength=BITMAP) & 1).astype(bool)).tobytes()


def _sets(rows: DataFrame, order) -> DataFrame:
    """(__row, same, n, fp, bitmap, prefix): a digest of the set of shingles, its size, the text's fingerprint, the set's bitmap and the hashes of its prefix."""
    over, under = LEAST[1], LEAST[0]

    def make():
        known, count, _ = order.value

        def work(texts: pa.Array):
            same, sizes, fps, bitmaps, prefix = [], [], [], [], []
            for text in utf8(texts):
                h = _hashes(text)
                n = len(h)
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(n)
                fps.append(simhash(text, SHINGLE))
                bitmaps.append(_bitmap(h))
                weight = np.zeros(n, np.int64)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    weight = np.where(known[at] == h, count[at], 0)
                prefix.append(h[np.lexsort((h, weight))[: n - -(-n * under // over) + 1]].tobytes())
            return same, sizes, np.array(fps, np.uint64).view(np.int64), bitmaps, prefix

        return work

    fields = [T.StructField(*f) for f in (("same", T.BinaryType()), ("n", T.LongType()), ("fp", T.LongType()), ("bitmap", T.BinaryType()), ("prefix", T.BinaryType()))]
    return materialise(map_texts(rows, make, ["text"], [c for c in ("__row", "doc_id") if c in rows.columns], fields), "shingles")


_ENTRY = np.dtype([("h", "<i8"), ("node", "<i8"), ("component", "<i8"), ("first", "<i8"), ("n", "<i4"), ("pos", "<i4")])
_MET = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "node", "component", "n", "pos", "prev")])
_PAIRS = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])
#: Meetings that are looked at at once.
AT_ONCE = 1 << 20


def _starts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries the group of each, equal hashes being one, and where the groups start."""
    first = np.append(True, rows["h"][1:] != rows["h"][:-1])
    return np.cumsum(first) - 1, np.flatnonzero(first)


def _star_pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of entries sorted by h and pos: the first of each h with the others."""
    group, start = _starts(rows)
    other = np.setdiff1d(np.arange(len(rows)), start)
    for i in range(0, len(other), AT_ONCE):
        part = other[i : i + AT_ONCE]
        yield start[group[part]], part


def _cross_pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of entries sorted by h: all two of an h that are of different components."""
    group, start = _starts(rows)
    low, high = (f.reduceat(rows["component"], start) for f in (np.minimum, np.maximum))
    stop = np.append(start[1:], len(rows))[group]
    left = np.flatnonzero((low < high)[group])  # of an h with more than one component
    step = 1
    while len(left):
        left = left[left + step < stop[left]]
        for i in range(0, len(left), AT_ONCE):
            part = left[i : i + AT_ONCE]
            part = part[rows["component"][part] != rows["component"][part + step]]
            yield part, part + step
        step += 1


def _able(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two entries of a hash can be the first that two similar sets share: at most what follows them is common, too."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    size = np.minimum(n, m) * LEAST[1] >= np.maximum(n, m) * LEAST[0]
    return size & (np.minimum(n - x["pos"], m - y["pos"]) * sum(LEAST) >= (n + m) * LEAST[0])


def _partnered(rows: np.ndarray) -> np.ndarray:
    """The nodes of entries that can be similar to another one of their hash and may meet it there first, and more rarely others."""
    by = rows[np.lexsort((rows["n"], rows["h"]))]
    near = (by["h"][1:] == by["h"][:-1]) & (by["n"][:-1].astype(np.int64) * LEAST[1] >= by["n"][1:].astype(np.int64) * LEAST[0])
    group, start = _starts(by)
    two = np.diff(np.append(start, len(by)))[group] == 2  # where the only pair can be judged as a whole
    near &= ~two[1:] | _able(by[1:], by[:-1])
    low, high = (f.reduceat(by["first"], start) for f in (np.minimum, np.maximum))
    near &= ((low != high) | (low == by["h"][start]))[group][1:]  # else all of them meet at their first hash
    return np.unique(by["node"][np.append(near, False) | np.append(False, near)])


def _meetings(own: DataFrame, order, pairs: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], alone: bool = False) -> DataFrame:
    """(a, b), not distinct: the pairs that ``pairs`` picks of prefix entries with equal hashes and that can be similar.

    own: nodes (node, n, prefix, component). Entries of common hashes are left to ``_common``. Two sets whose first shingles are equal
    meet there only, other ones wherever they may have met first. ``alone`` adds (a, a) for nodes that may be similar to any other.
    """
    targets = max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches):
        _, _, hot = order.value
        for batch in batches:
            rows = _entries(batch)
            yield _dealt(rows[~np.isin(rows["h"], hot)], targets)
        release()

    def meet(batches):
        rows = _gathered(batches, _ENTRY)
        rows = rows[np.argsort(rows["h"], kind="stable")]
        same = rows["h"][1:] == rows["h"][:-1]
        rows = rows[np.append(same, False) | np.append(False, same)] if len(rows) else rows  # those whose hash occurs again
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["node"], rows["pos"], rows["h"]))]
        found = [np.zeros((0, 2), np.int64)]
        for i, j in pairs(rows):
            x, y = rows[i], rows[j]
            fit = _able(x, y) & ((x["first"] != y["first"]) | (x["first"] == x["h"]))
            found.append(np.unique(np.sort(np.stack([x["node"][fit], y["node"][fit]], axis=1), axis=1), axis=0))
        out = np.unique(np.concatenate(found), axis=0)
        if alone:
            ids = np.setdiff1d(_partnered(rows), out)
            out = np.concatenate([out, np.stack([ids, ids], axis=1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(2)], names=_PAIRS.names)
        del rows, found, out
        release()

    return own.select("node", "n", "component", "prefix").mapInArrow(deal, _SENT).repartitionById(targets, "to").mapInArrow(meet, _PAIRS)


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """One entry for each hash of each prefix."""
    each = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
    counts = [len(x) for x in each]
    out = np.empty(sum(counts), _ENTRY)
    if len(out):
        out["h"] = np.concatenate(each)
        out["pos"] = np.concatenate([np.arange(c) for c in counts])
        out["first"] = np.repeat([x[0] if len(x) else 0 for x in each], counts)
    for c in ("node", "n", "component"):
        out[c] = np.repeat(batch.column(c).to_numpy(), counts)
    return out


def _common(own: DataFrame, order) -> DataFrame:
    """The entries (h, node, component, n, pos, prev) of hashes that the sample shows to be common, without an exchange.

    prev: the hash before it in the prefix, common or not; 0 for the first.
    """

    def run(batches):
        _, _, hot = order.value
        for batch in batches:
            rows = _entries(batch)
            prev = np.where(rows["pos"] > 0, np.roll(rows["h"], 1), 0)
            own = np.isin(rows["h"], hot)
            rows, prev = rows[own], prev[own]
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[c].astype(np.int64)) for c in _MET.names[:-1]), pa.array(prev)], names=_MET.names)

    return own.select("node", "n", "component", "prefix").mapInArrow(run, _MET)


def _small(ids: DataFrame) -> DataFrame:
    """A written table of row numbers, marked for broadcast if it has few enough; else what it is joined to is shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _joined(pairs: DataFrame, values: DataFrame, column: str, name: str) -> DataFrame:
    """The written pairs (a, b) with the column of both rows, as left and right; the others' values aren't shuffled."""
    ids = materialise(pairs.select(F.col("a").alias("__row")).union(pairs.select(F.col("b").alias("__row"))).distinct(), f"{name}-ids")
    own = values.select("__row", column).join(_small(ids), "__row", "left_semi")
    return pairs.join(own.toDF("a", "left"), "a").join(own.toDF("b", "right"), "b")


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) of rows whose texts are similar: the bitmaps of their sets rule out most others, the texts decide."""

    def bounded():
        def work(left: pa.Array, right: pa.Array):
            (n, x), (m, y) = ((side.field("n").to_numpy(), np.frombuffer(b"".join(side.field("bitmap").to_pylist()), np.uint64).reshape(len(side), -1)) for side in (left, right))
            common = n + m - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)  # twice, at most
            return ((np.minimum(n, m) * LEAST[1] >= np.maximum(n, m) * LEAST[0]) & (common * sum(LEAST) >= 2 * LEAST[0] * (n + m)),)

        return work

    def compared():
        def work(left: pa.Array, right: pa.Array):
            return ([similar(shingles(x), shingles(y)) for x, y in zip(utf8(left), utf8(right), strict=True)],)

        return work

    def those(both: DataFrame, make: Callable, name: str) -> DataFrame:
        return materialise(map_texts(both, make, ["left", "right"], ["a", "b"], [T.StructField("ok", T.BooleanType())]).filter("ok").select("a", "b"), name)

    own = sets.select("__row", F.struct("n", "bitmap").alias("s"))
    return those(_joined(those(_joined(pairs, own, "s", "pairs"), bounded, "hopeful"), rows, "text", "texts"), compared, "similar")


def _signature_pairs(own: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) such that exactly those of fingerprints within 2 bits are connected, by one-wildcard signatures."""
    marked = own.select("node", "fp")
    fps = materialise(marked.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = marked.join(fps, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = links(fps.select("fp")).join(fps.toDF("a", "x"), "a").join(fps.toDF("b", "y"), "b")
    return equal.union(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _can_meet(x: str, y: str) -> Column:
    """As ``_able``, of the rows x and y."""
    n, m, i, j = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (x, y))
    return (F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]) & (F.least(n - i, m - j) * sum(LEAST) >= (n + m) * LEAST[0])


def _ends() -> list[Column]:
    """The nodes of the rows x and y as a and b, the lesser first."""
    return [f("x.node", "y.node").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]


def _common_stars(common: DataFrame) -> DataFrame:
    """(a, b), not distinct: of each common hash the entry of the earliest place with the others that can be similar."""
    centre = common.groupBy("h").agg(F.min(F.struct("pos", "node", "n")).alias("x")).select("h", "x.*").alias("x")
    return common.alias("y").join(centre, "h").filter((F.col("y.node") != F.col("x.node")) & _can_meet("x", "y")).select(*_ends())


def _common_pairs(common: DataFrame) -> DataFrame:
    """(a, b), not distinct: entries of a common hash of different components that can be similar.

    One of such two is outside the largest component of the hash, so only those outside are held against the others, and none
    where a component has them all. Two whose hashes before are equal have met there, or at a hash before that.
    """
    sizes = common.groupBy("h", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("h").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("some")).filter("some > 1")
    left = materialise(common.join(mixed, "h").select(*_MET.names, (F.col("component") != F.col("main")).alias("outside")), "mixed")
    once = ~F.col("y.outside") | (F.col("x.node") < F.col("y.node"))
    new = (F.col("x.prev") != F.col("y.prev")) | (F.col("x.pos") == 0) | (F.col("y.pos") == 0)
    both = left.filter("outside").alias("x").join(left.alias("y"), "h")
    return both.filter(once & new & (F.col("x.component") != F.col("y.component")) & _can_meet("x", "y")).select(*_ends())


def classes(rows: DataFrame) -> DataFrame:
    """(__row, doc_id if there, component) for each of ``rows`` (__row: a unique long, text)."""
    order = rows.sparkSession.sparkContext.broadcast(_order(rows))
    sets = _sets(rows, order)
    nodes = materialise(sets.groupBy("same").agg(F.min("__row").alias("node")), "nodes")
    own = sets.join(_small(nodes.select(F.col("node").alias("__row"))), "__row", "left_semi").withColumnRenamed("__row", "node").withColumn("component", F.col("node"))

    linked = _verified(materialise(_signature_pairs(own), "signed"), sets, rows)

    common = materialise(_common(own, order), "common")
    met = materialise(_meetings(own, order, _star_pairs, alone=True), "met")
    stars = met.filter("a <> b").unionAll(_common_stars(common)).distinct().join(linked, ["a", "b"], "left_anti")
    linked = linked.unionAll(_verified(materialise(stars, "stars"), sets, rows))
    settled = _small(materialise(components(linked), "settled"))
    component = F.coalesce("component", "node").alias("component")
    # nodes that can be similar to no other needn't be looked at again
    meeting = materialise(met.select(F.col("a").alias("node")).unionAll(met.select(F.col("b").alias("node"))).unionAll(common.select("node")).distinct(), "meeting")
    own = own.drop("component").join(_small(meeting), "node", "left_semi").join(settled, "node", "left").select("node", "n", "prefix", component)
    common = common.drop("component").join(settled, "node", "left").select(*(component if c == "component" else c for c in _MET.names))
    pairs = materialise(_meetings(own, order, _cross_pairs).unionAll(_common_pairs(common)).distinct(), "pairs")
    of = components(linked.unionAll(_verified(pairs, sets, rows)))
    named = nodes.join(of, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    found = materialise(sets.join(named, "same").select("__row", *(["doc_id"] if "doc_id" in sets.columns else []), "component"), "classes")
    discard(sets)
    return found


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id; rows without doc_id come last."""
    rows = numbered_rows(docs)
    return one_row_each(rows, classes(rows)).select(*docs.columns)
