"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints that differ in at most 2 bits, cut into 2 segments, have one segment that
differs in at most one bit. So each distinct fingerprint is indexed under 64 signatures: a segment with one bit taken
out (the wildcard). Equal signatures are candidates. A signature of two members is verified at once by its Hamming
distance. Members of a wider signature are verified without making pairs: two fingerprints lie within 2 bits exactly if
some 64-bit value lies within one bit of both, so members meet at the values within one bit of them, each of which has
at most 65 members. All links are kept; copies never meet each other as they share one distinct fingerprint.

Both size checks (BROADCAST_SIGNATURES) choose between plans of the same rows. Beyond some 2**31 distinct fingerprints chance
makes nearly every signature wide; then all values within one bit are indexed, 65 rows more for each fingerprint.

Defined cases: null and wordless texts have fingerprint zero and link like any other; very long texts are read whole; rows
with equal doc_id keep a row each; a null doc_id counts only if its component has no other; an empty table gives an empty
result; columns __row, fp, component_id and component of the input are replaced by the operator's.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.llm.common import map_texts, utf8, without
from framequarry.llm.graph import components
from framequarry.session import materialise

SHINGLE = 3
SEED = 42
#: Signatures (of 8 bytes) that are broadcast at most.
BROADCAST_SIGNATURES = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) <= shingle:
        return hashed(b" ".join(words))
    n = len(words) - shingle + 1
    h = np.fromiter(map(hashed, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):  # the bits of a very long text in parts
        ones += np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` and fp: the 64-bit fingerprint as a signed long."""

    def make():
        def work(texts: pa.Array):
            return (np.array([simhash(t, shingle) for t in utf8(texts)], np.uint64).view(np.int64),)

        return work

    return map_texts(docs, make, ["text"], keep, [T.StructField("fp", T.LongType())])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, such that exactly those within 2 bits are connected."""
    tag = F.col("tag")
    segment = F.when(tag < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    wildcard = F.expr("shiftleft(1L, cast(tag % 32 as int))")
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("tag")).select("fp", (F.shiftleft(tag.cast("long"), 32) + segment.bitwiseAND(F.bitwise_not(wildcard))).alias("signature"))
    groups = variants.groupBy("signature").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    groups = materialise(groups, "signatures")
    pairs = groups.filter("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")
    hot = groups.filter("n > 2").select("signature")
    if hot.count() <= BROADCAST_SIGNATURES:  # else both sides are shuffled
        hot = F.broadcast(hot)
    wide = variants.join(hot, "signature", "left_semi").select("fp").distinct()
    near = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = wide.select("fp", F.explode(near).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("members")).filter("size(members) > 1")
    stars = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, labels: bool = False) -> DataFrame:
    """Columns ``keep`` with fp and component_id, the smallest doc_id that links of at most 2 bits reach.

    ``labels`` adds component, its smallest fingerprint, which is there for components without doc_id, too.
    """
    added = ("fp", "component_id", "component")
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in added]
    docs = without(docs, added)
    marked = materialise(fingerprints(docs, list(dict.fromkeys(["doc_id", *keep])), shingle), "simhash")
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    linked = components(links(fps)).withColumnsRenamed({"node": "fp"}).join(fps, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    merged = linked.join(least, "component").select("fp", "least", "component")
    classes = materialise(fps.join(merged, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "fp").alias("component")), "classes")
    return marked.join(classes, "fp", "left").select(*keep, "fp", "component_id", *(["component"] if labels else []))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` written with __row, a unique number that stays the same however often the table is read."""
    return materialise(docs.withColumnRenamed("__row", "__input_row").withColumn("__row", F.monotonically_increasing_id()), "rows")


def one_row_each(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of ``rows`` one of each component of ``found`` (__row, doc_id, component): the smallest doc_id, null last, then __row."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    best = found.groupBy("component").agg(F.min(key).alias("best")).select(F.col("best.__row").alias("__row"))
    lost = found.select("__row").join(best, "__row", "left_anti")  # mostly few
    lost = materialise(lost, "lost")
    kept = rows.join(F.broadcast(lost) if lost.count() <= BROADCAST_SIGNATURES else lost, "__row", "left_anti").drop("__row")
    return kept.withColumnRenamed("__input_row", "__row")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate component: that of the smallest doc_id (of equal ones, any one); null ids come last."""
    rows = numbered_rows(docs)
    found = near_duplicates(rows, ["__row", "doc_id"], labels=True)
    return one_row_each(rows, found).select(*docs.columns)
