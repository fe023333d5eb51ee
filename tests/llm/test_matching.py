"""Decontamination, SimHash and packing against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import xxhash
from tokenizers import Tokenizer

from framequarry.llm import decontaminate, packing, queries, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def hits(text, items, window=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        w = WORD.findall((item or "").translate(LOWER))
        n = min(window, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if w and tuple(words[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(name)
    return len(words), len(hit), sorted(found)


def test_op3_equals_window_search(spark, sf):
    items = [(str(r["item_id"]), r["text"]) for r in table(sf, "benchmark")]
    got = {r.doc_id: r for r in queries.op3_decontaminate(spark, sf).collect()}
    for d in table(sf, "documents"):
        n, n_hit, found = hits(d["text"], items)
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, n_hit, len(found), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert any(r.contaminated for r in got.values())


def test_scan_small_items_blocks_and_odd_rows(spark, odd, empty):
    items = [("a", "quick brown"), ("b", None), ("c", ""), ("d", "Fox"), ("e", "fox"), ("f", "brown fox jumps over the lazy dog the quick brown fox jumps over"), (None, "lazy dog")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (2, 10_000):
        for r in decontaminate.scan(odd, bench, keep=["doc_id", "text"], block_words=block).collect():
            n, n_hit, found = hits(r.text, [(i or "", t) for i, t in items])
            assert (r.n_words, sum(s.stop - s.first for s in r.hit_spans), r.hit_items) == (n, n_hit, found)
    cleaned = {(r.doc_id, r.text) for r in decontaminate.decontaminate(odd, bench, max_coverage=0.9).collect()}
    assert (7, "The  jumps over the !") in cleaned and (4, "Ω") in cleaned and (None, None) in cleaned
    assert decontaminate.decontaminate(empty, bench).columns == empty.columns
    assert decontaminate.scan(odd, bench.limit(0)).count() == odd.count()


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def classes(ids_fps):
    parent = list(range(len(ids_fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids_fps)):
        for j in range(i):
            if (ids_fps[i][1] ^ ids_fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(ids_fps):
        least[root(i)].append(d)
    return [min((d for d in least[root(i)] if d is not None), default=None) for i in range(len(ids_fps))]


def test_op7_equals_all_pairs(spark, sf):
    docs = table(sf, "documents")
    fps = [(d["doc_id"], slow_simhash(d["text"])) for d in docs]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(fps, classes(fps), strict=True)}
    assert {tuple(r) for r in queries.op7_simhash(spark, sf).collect()} == want


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(12):
        base = int(rng.integers(1 << 63))
        for _ in range(30):  # chains, stars and wide signature groups
            fps.add(base)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                base ^= 1 << int(b)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from framequarry.llm.graph import components

    label = {r.node % (1 << 64): r.component for r in components(simhash.links(df)).collect()}
    want = classes(list(zip(fps, fps, strict=True)))
    got = defaultdict(set)
    for f, c in zip(fps, want, strict=True):
        got[c].add(label.get(f, f))
    assert all(len(x) == 1 for x in got.values()) and len({next(iter(x)) for x in got.values()}) == len(got)


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd, keep=["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    fps = [(r.doc_id, r.fp % (1 << 64)) for r in rows]
    assert [r.component_id for r in rows] == classes(fps)
    assert all(f == slow_simhash(r.text) for (_, f), r in zip(fps, rows, strict=True))
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 5, 8, None}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_representatives(empty).count() == 0


def check_packing(rows, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    return len(used), -(-sum(r.length for r in rows) // 2048)


def test_op9_packs_every_token(spark, sf):
    rows = queries.op9_packing(spark, sf).collect()
    n, least = check_packing(rows, [(d["doc_id"], d["text"]) for d in table(sf, "documents")])
    assert n <= least + 1


def test_packing_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(odd.select("doc_id", "text"), path).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(empty, path).count() == 0
    assert packing.pack(odd, path, keep=["doc_id", "length", "source"], with_ids=True).count() == len(rows)


def test_word_encoder_equals_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, mine = Tokenizer.from_file(path), packing.WordEncoder(path)
    for text in ["It's ΟΔΥΣΣΕΎΣ İstanbul été x y ́z <|endoftext|> a<|startoftext|>b", "don't   12,345.67\r\n\tÀÉÎ÷×ø ﬁ ﬀ ǅ 日本 😀!!", "we'll they'd I'M", "", " \n ", "a b\u0085c\x1cd\x0be", "ÿĀſƒɏɐ ß ẞ"]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plan_places_each_rank_once():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(600, 1200, 500), rng.integers(1, 40, 999), [2048] * 5 + [1024] * 3, [700] * 4, []):
        counts = defaultdict(int)
        for n in lengths:
            counts[int(n)] += 1
        plan = packing.Plan(dict(counts))
        given = defaultdict(list)
        runs = sorted(plan.runs)
        for i, (n, first, *_rest) in enumerate(runs):
            stop = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else counts[n]
            given[n] += range(first, stop)
        assert {n: len(x) for n, x in given.items()} == dict(counts) and not plan.left


def test_op3_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = {tuple(r) for r in con.execute(queries.ORACLE_SQL["op3_decontaminate"]).fetchall()}
    assert {tuple(r) for r in queries.op3_decontaminate(spark, sf).collect()} == want


def test_plan_pairs_odd_counts():
    assert packing.Plan({1000: 1, 900: 1}).sequences == 1
    lengths = np.random.default_rng(3).choice(np.arange(690, 1025), 301, replace=False)
    assert packing.Plan({int(n): 1 for n in lengths}).sequences == 151
    assert packing.Plan({1000: 3, 900: 3, 700: 1}).sequences == 4
    assert packing.Plan({1000: 3, 900: 3, 800: 3}).sequences == 5
    assert packing.Plan({1020: 1, 1010: 1, 1001: 1, 999: 1}).sequences == 2


def fewest(items, capacity):
    """The least number of sequences, by trying all placements."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            k = rooms.index(room)
            place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_loses_no_sequence():
    rng = np.random.default_rng(11)
    for _ in range(400):
        capacity = int(rng.integers(10, 30))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 10))).tolist()
        counts = {n: items.count(n) for n in set(items)}
        plan = packing.Plan.__new__(packing.Plan)
        plan.capacity, plan.sequences, plan.fixed, plan.left, plan.given, plan.runs = capacity, 0, 0, dict(counts), defaultdict(int), []
        plan._reduce()
        rest = [n for n, c in plan.left.items() for _ in range(c)]
        assert plan.sequences + fewest(rest, capacity) == fewest(items, capacity)
        assert packing.plan(counts, capacity).sequences <= packing.Plan(counts, capacity, reduce=False).sequences


def test_plan_is_no_worse_than_best_fit():
    rng = np.random.default_rng(0)
    for low, high, n in ((600, 1101, 5000), (300, 900, 2000), (1, 2049, 5000), (5, 300, 3000)):
        values, counts = np.unique(rng.integers(low, high, n), return_counts=True)
        counts = {int(v): int(c) for v, c in zip(values, counts, strict=True)}
        assert packing.plan(counts).sequences <= packing.Plan(counts, reduce=False).sequences


def test_simhash_takes_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 3), (2, "a b c", "x", "y", 4)], "doc_id long, text string, fp string, component_id string, __row int")
    rows = simhash.near_duplicates(docs, keep=["doc_id", "fp", "text"]).collect()
    assert {r.component_id for r in rows} == {1} and len({r.fp for r in rows}) == 1
    assert [tuple(r) for r in simhash.keep_representatives(docs).collect()] == [(1, "a b c", "x", "y", 3)]
