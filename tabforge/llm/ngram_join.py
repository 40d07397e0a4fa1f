"""N-gram Jaccard join: T-occurrence search with divided lists, distributed.

Two documents link when their shingle sets reach the similarity, which asks for an overlap of at
least T grams. As in DivideSkip, each document's inverted lists are divided: its T - 1 longest
lists (most frequent grams) are set aside and only the short ones are merged, here by a shuffle on
the gram. Every linked pair meets in a short list. Inside a search (one query set against a chunk
of candidate sets) the same division is made again: short lists are merged with a heap, long ones
probed by binary search, and documents that reach the overlap are kept and checked exactly.

1. Sets are hashed from whole texts; equal sets become one class (every copy group is one node).
2. Frequent grams are found by counting; the order (frequency, hash) decides which lists are short.
3. Each node searches with one query of its short lists (the closest by a parity sketch, whose
   differing bits never exceed the true difference); links give components.
4. Lists that still join different components are compared in blocks of bounded size by sizes, by
   the place in the order at which two sets can first meet, and by the same bound; every pair left
   over is searched too. No pair of different components stays untested,
   so components are exact, while pairs inside a component need not be emitted.

Links are followed by alternating large-star and small-star steps over staged tables.

Defined results: null, empty or blank text has the empty set and is its own component; rows
repeated under one doc_id each get a row; a null doc_id takes part, its component is the smallest
non-null id it reaches (or null); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, free_prefix, shuffle_partitions, stage, unstage
from .shingles import mix, shingle_set

SHINGLE = 4
PERCENT = 85
#: Grams counted at least so often in one batch of texts are reported; the most frequent
#: ``FREQUENT_MAX`` of them go last in the order. This steers cost alone, never the links.
FREQUENT_LOCAL, FREQUENT_MAX, COUNT_BATCH = 4, 100_000, 4_000_000
#: Documents from which a gram's list is taken as shared without counting its nodes.
COMMON = 1000
#: Candidate sets in one search, and list entries in one block.
CHUNK, BLOCK = 256, 256
BROADCAST_ROWS = 500_000
_MU = 0.0085
_NULL = -(2**63)
#: Bits of a list entry's place in its document's order.
_PLACE_BITS = 24


# ---- sets and sketches -------------------------------------------------------------------------


def prefix_length(n: int, percent: int) -> int:
    """Lists to merge so that a partner of any size is met: n - T + 1 with T = ceil(percent n)."""
    return n - -(-percent * n // 100) + 1


def most_different(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def parity_sketch(grams: np.ndarray, percent: int) -> bytes:
    """Parity of the gram count in each of 2^k cells, about eight per allowed difference. Two
    sketches differ in at most as many bits as the sets differ in grams, and in nearly as many."""
    cells = 64
    while cells < 8 * most_different(len(grams), len(grams), percent):
        cells *= 2
    at = np.bincount((mix(grams) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def _fold(x: int, have: int, want: int) -> int:
    while have > want:
        have //= 2
        x = (x >> have) ^ (x & ((1 << have) - 1))
    return x


def may_link(na: int, sa: tuple[int, int], nb: int, sb: tuple[int, int], percent: int) -> bool:
    """False only for pairs that cannot link. A sketch is (bits as an integer, number of cells)."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    cells = min(sa[1], sb[1])
    return (_fold(*sa, cells) ^ _fold(*sb, cells)).bit_count() <= most_different(na, nb, percent)


def _halved(batches):
    """uid and sketch folded once (never below 64 cells): four cells and more per allowed difference
    still tell unrelated sets apart, and the sketch is what a compared list entry mostly consists of."""
    for b in batches:
        cells = [np.frombuffer(s, np.uint8) for s in b.column(1).to_pylist()]
        half = [(c[: len(c) // 2] ^ c[len(c) // 2 :] if len(c) > 8 else c).tobytes() for c in cells]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(half, pa.binary())], ["uid", "sketch"])


def _bits(raw: bytes) -> tuple[int, int]:
    return int.from_bytes(raw, "little"), 8 * len(raw)


def frequent_grams(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of grams that many documents share (bounded list, all texts)."""

    def count(batches):
        held, size = [], 0

        def flush():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= FREQUENT_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["gram", "n"])

        for b in batches:
            for t in b.column(0):
                held.append(shingle_set(t.as_py(), shingle))
                size += len(held[-1])
                if size >= COUNT_BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT_MAX).collect()
    grams = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r["n"] for r in rows], np.int64)[order]


def set_key(g: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set of grams (empty: zeros)."""
    if not len(g):
        return 0, 0
    return int(np.add.reduce(mix(g ^ np.uint64(1))).view(np.int64)), int(np.add.reduce(mix(g ^ np.uint64(0x9E3779B97F4A7C15))).view(np.int64))


def gram_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, d, n, k1, k2 (128-bit key of the set), prefix and common (its short lists; common
    are those of ``COMMON`` documents and more), sketch."""
    hot, freq = frequent_grams(docs, shingle)

    def rows(batches):
        for b in batches:
            out = {k: [] for k in ("n", "k1", "k2", "prefix", "common", "sketch")}
            for t in b.column(1):
                g = shingle_set(t.as_py(), shingle)
                weight = np.zeros(len(g), np.int64)
                if len(hot) and len(g):
                    at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
                    weight = np.where(hot[at] == g, freq[at], 0)
                short = np.lexsort((g, weight))[: prefix_length(len(g), percent) if len(g) else 0]
                out["n"].append(len(g))
                k1, k2 = set_key(g)
                out["k1"].append(k1)
                out["k2"].append(k2)
                often = weight[short] >= COMMON
                out["prefix"].append(g[short[~often]].view(np.int64))
                out["common"].append(g[short[often]].view(np.int64))
                out["sketch"].append(parity_sketch(g, percent) if len(g) else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(out["n"], pa.int64()), pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int64()),
                    pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["common"], pa.list_(pa.int64())), pa.array(out["sketch"], pa.binary()),
                ],
                ["doc_id", "n", "k1", "k2", "prefix", "common", "sketch"],
            )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, n long, k1 long, k2 long, prefix array<long>, common array<long>, sketch binary"
    )
    return stage(made.withColumn("uid", F.monotonically_increasing_id()), "gram-sets")


# ---- the search --------------------------------------------------------------------------------


def divide_skip(query: np.ndarray, chunk: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """Ids of the chunk's sets that link with the query: T-occurrence by divided lists."""
    nq = len(query)
    need = -(-percent * nq // 100)
    lists: list[list[int]] = [[] for _ in range(nq)]
    for k, (_, grams) in enumerate(chunk):
        if 100 * min(nq, len(grams)) < percent * max(nq, len(grams)):
            continue
        at = np.searchsorted(query, grams)
        at[at == nq] = nq - 1
        for j in at[query[at] == grams].tolist():
            lists[j].append(k)  # ascending: the chunk is walked in order
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < need:
        return []
    longest = len(lists[-1])
    n_long = min(need - 1, int(need / (_MU * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out = []
    for k, same in groupby(heapq.merge(*short)):
        seen = sum(1 for _ in same)
        if seen < need - n_long:
            continue
        for x in long:
            at = bisect_left(x, k)
            seen += at < len(x) and x[at] == k
        node, grams = chunk[k]
        if 100 * seen >= percent * (nq + len(grams) - seen):
            out.append(node)
    return out


def _runs(batches, keys: int):
    """Lists of rows with equal first ``keys`` columns, from rows sorted on them."""
    parts = (b.slice(lo, BLOCK) for b in batches for lo in range(0, b.num_rows, BLOCK))
    rows = (r for b in parts for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, run in groupby(rows, key=lambda r: r[:keys]):
        yield key, run


def search(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (q, d) of ``wanted`` (staged) that link. Candidates of a query are dealt over
    chunks, the query goes to each; texts are read again for the sets of these nodes alone."""
    sizes = wanted.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = wanted.join(sizes, "q").select("q", F.pmod(F.xxhash64("d"), F.col("chunks")).cast("int").alias("chunk"), F.col("d").alias("node"))
    asked = sizes.select("q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("q").alias("node"))
    need = dealt.unionByName(asked).join(nodes.select(F.col("uid").alias("node"), "d", "k1", "k2"), "node")
    need = broadcast_if_small(stage(need, "search-need"), BROADCAST_ROWS)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), "text").join(need, "d").select("q", "chunk", "node", "k1", "k2", "text")

    def sets(batches):
        for b in by_bytes(batches, 5):
            keep, grams = [], []
            for i, (k1, t) in enumerate(zip(b.column(3).to_pylist(), b.column(5), strict=True)):
                g = shingle_set(t.as_py(), shingle)
                if len(g) and int(np.add.reduce(mix(g ^ np.uint64(1))).view(np.int64)) == k1:  # else another row of that id
                    keep.append(i)
                    grams.append(g.tobytes())
            kept = b.select(["q", "chunk", "node"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(grams, pa.binary())], ["q", "chunk", "node", "grams"])

    def verify(batches):
        for (q, _), run in _runs(batches, 2):
            got = {node: np.frombuffer(g, np.uint64) for _, _, node, g in run}
            query = got.pop(q, None)
            found = divide_skip(query, list(got.items()), percent) if query is not None and got else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.int64()), pa.array(found, pa.int64())], ["q", "d"])

    parts = shuffle_partitions(docs.sparkSession)
    have = texts.mapInArrow(sets, "q long, chunk int, node long, grams binary").repartition(parts, "q", "chunk").sortWithinPartitions("q", "chunk")
    return have.mapInArrow(verify, "q long, d long")


# ---- components --------------------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (a, b)."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select("x.*")
        last, e = e, stage(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        unstage(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


# ---- the join ----------------------------------------------------------------------------------


def _bucket(n, percent: int):
    """Sizes of linked sets lie in one bucket or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _first_candidates(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """For every node at most one query (q, d). A list's head is its node with the most shared
    lists (the text that others were made from shares all of its own); of the heads of a node's
    lists the one that heads most of them is taken, if the sketches allow a link."""
    shared = lists.groupBy("uid").agg(F.count(F.lit(1)).alias("shared"))
    at = lists.join(shared, "uid").withColumn("b", _bucket(F.col("n"), percent))
    best = F.max(F.struct(F.col("shared"), (-F.col("uid")).alias("u")))
    heads = at.groupBy("gram", "b").agg(best.alias("h")).select("gram", "b", (-F.col("h.u")).alias("q"))
    near = heads.unionByName(heads.withColumn("b", F.col("b") + 1))
    pairs = at.join(near, ["gram", "b"]).filter("q <> uid").groupBy("q", F.col("uid").alias("d")).agg(F.count(F.lit(1)).alias("met"))
    pairs = pairs.groupBy("d").agg(F.max_by("q", F.struct("met", "q")).alias("q"))
    own = nodes.select("uid", "n", "sketch")
    pairs = pairs.join(own.toDF("q", "nq", "sq"), "q").join(own.toDF("d", "nd", "sd"), "d")

    def bound(batches):
        for b in batches:
            out = [
                (q, d)
                for q, nq, sq, d, nd, sd in zip(*(b.column(c).to_pylist() for c in ("q", "nq", "sq", "d", "nd", "sd")), strict=True)
                if may_link(nq, _bits(sq), nd, _bits(sd), percent)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["q", "d"])

    return pairs.mapInArrow(bound, "q long, d long")


def largest_partner(n, place, percent: int):
    """Largest set that a set of n grams can link with if its first common gram is at ``place`` of
    the order: all common grams are at or behind it, so they are at most n - place, and a link with
    b grams needs percent (n + b) / (100 + percent) of them."""
    return (n - place) * (100 + percent) // percent - n


def _other_candidates(lists: DataFrame, nodes: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Every pair (q, d) of different components that shares a short list and may link. A list
    is compared block against block, so no task holds more than two blocks of one list. A node goes
    where no set of the list is small enough for its place, and in a block it meets only those of
    fitting sizes, found by bisection: documents alike up to just below the similarity meet late in
    the order and make no pairs."""
    at = lists.join(comp.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    at = at.withColumn("most", F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n"))
    mixed = at.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("lo <> hi")
    at = at.join(mixed.select("gram", "least", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "gram")
    at = at.filter(F.col("most") >= F.greatest("least", F.ceil(F.col("n") * percent / 100)))
    own = F.pmod(F.xxhash64(F.lit("block"), "uid"), F.col("blocks")).cast("int")
    at = at.withColumn("own", own).join(nodes.select("uid", "sketch").mapInArrow(_halved, "uid long, sketch binary"), "uid")
    at = at.select("gram", "uid", "n", "most", "root", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    at = at.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid", "n", "most", "root", "sketch", "own")

    def compare(batches):
        done: set[tuple[int, int]] = set()
        for (_, i, j), run in _runs(batches, 3):
            rows = [(n, uid, most, root, _bits(s), own) for _, _, _, uid, n, most, root, s, own in run]
            left = [r for r in rows if r[5] == i]
            right = sorted((r for r in rows if r[5] == j), key=lambda r: r[0])
            sizes = [r[0] for r in right]
            out: list[tuple[int, int]] = []
            for n, uid, most, root, sketch, _ in left:
                lo = bisect_left(sizes, -(-n * percent // 100))
                for nb, other, most_b, root_b, sketch_b, _ in right[lo : bisect_right(sizes, min(most, n * 100 // percent))]:
                    if root != root_b and most_b >= n:
                        pair = (min(uid, other), max(uid, other))
                        if pair not in done:
                            done.add(pair)
                            if may_link(n, sketch, nb, sketch_b, percent):
                                out.append(pair)
            if len(done) > 1_000_000:  # only saves repeated tests
                done.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["q", "d"])

    parts = shuffle_partitions(nodes.sparkSession)
    at = at.repartition(parts, "gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return at.mapInArrow(compare, "q long, d long").distinct()


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_size (rows with
    the same set), for documents whose ``shingle``-word sets reach ``percent`` % Jaccard."""
    return _components(docs, shingle, percent, [])


def _components(docs: DataFrame, shingle: int, percent: int, extra: list[str]) -> DataFrame:
    """``jaccard_components`` with ``extra`` of: k1, k2 (key of the row's set), root (of its component)."""
    sets = gram_sets(docs, shingle, percent)
    d = F.coalesce("doc_id", F.lit(_NULL))
    classes = sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("class_size"))
    classes = stage(classes, "gram-classes")
    nodes = stage(sets.select("uid", "n", "sketch", d.alias("d")).join(classes, "uid"), "gram-nodes")
    own = sets.select("uid", "n", "prefix", "common").join(classes.select("uid"), "uid", "left_semi")
    # size and place in the order share a number: the lists are what is shuffled most
    at = F.shiftleft("n", _PLACE_BITS) + F.col("place")
    entries = own.select("uid", "n", F.posexplode("prefix").alias("place", "gram")).select("uid", at.alias("at"), "gram")
    often = own.select("uid", "n", F.size("prefix").alias("_rare"), F.posexplode("common").alias("place", "gram"))
    often = often.withColumn("place", F.col("place") + F.col("_rare")).select("uid", at.alias("at"), "gram")
    # short lists of two or more nodes; most grams are in one and go. Grams of very many documents are
    # not counted again, so that no task gathers one
    shared = entries.selectExpr("uid", "at", "gram", "count(1) over (partition by gram) as m").filter("m > 1").drop("m")
    held = stage(shared.unionByName(often), "gram-lists")
    place = F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    lists = held.select("uid", F.shiftright("at", _PLACE_BITS).alias("n"), place.alias("place"), "gram")
    first = stage(_first_candidates(lists, nodes, percent), "first-pairs")
    comp = connected(search(docs, nodes, first, shingle, percent).toDF("a", "b"))
    rest = stage(_other_candidates(lists, nodes, comp, percent), "other-pairs")
    if rest.limit(1).count():
        more = search(docs, nodes, rest, shingle, percent).toDF("a", "b")
        comp = connected(comp.toDF("a", "b").unionByName(more))
    member = nodes.select("uid", "first_id").join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = member.join(lowest, "root").select("uid", "component_id", "root").join(classes.select("uid", "k1", "k2", "class_size"), "uid")
    out = sets.filter("n > 0").select("doc_id", "n", "k1", "k2").join(of, ["k1", "k2"])
    alone = sets.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "class_size": F.lit(1).cast("long"), "root": F.col("uid")})
    shown = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size", *extra]
    out = stage(out.select(*shown).unionByName(alone.select(*shown)), "components")
    unstage(sets, classes, nodes, held, first, rest)
    return out


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each component the document of the smallest id stays
    (one row of it, if it is repeated; of rows of that id with other sets, the one of the smallest
    set key); documents without words or without an id stay."""
    comp = _components(docs, shingle, percent, ["k1", "k2", "root"])
    stays = comp.filter(F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    stays = broadcast_if_small(stage(stays, "stays"), BROADCAST_ROWS)
    by_id = docs["doc_id"].eqNullSafe(stays["_keep"])
    repeated = comp.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_repeated"))
    repeated = stage(repeated, "repeated-ids")
    if not repeated.limit(1).count():
        return docs.join(stays, by_id, "left_semi")
    once = docs.join(repeated, docs["doc_id"] == repeated["_repeated"], "left_anti").join(stays, by_id, "left_semi")
    # rows of a repeated id may lie in several components, so they are told apart by their sets
    first = comp.filter("n_shingles > 0 and doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("s"))
    first = stage(first.select(F.col("s.doc_id").alias("_id"), F.col("s.k1").alias("_f1"), F.col("s.k2").alias("_f2")), "first-rows")
    n, k1, k2 = (free_prefix(docs.columns) + c for c in ("n", "k1", "k2"))
    rows = _with_key(docs.join(repeated, docs["doc_id"] == repeated["_repeated"], "left_semi"), shingle, [n, k1, k2])
    same = (rows["doc_id"] == first["_id"]) & (rows[k1] == first["_f1"]) & (rows[k2] == first["_f2"])
    kept = rows.filter(rows[n] > 0).join(first, same, "left_semi").dropDuplicates(["doc_id", k1, k2]).unionByName(rows.filter(rows[n] == 0))
    return once.unionByName(kept.select(*docs.columns))


def _with_key(docs: DataFrame, shingle: int, names: list[str]) -> DataFrame:
    """``docs`` plus size and key (two numbers) of each row's set, under ``names``."""
    kept, schema = docs.columns, docs.schema

    def rows(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(kept.index("text"))]
            keys = [set_key(g) for g in sets]
            made = [[len(g) for g in sets], [k[0] for k in keys], [k[1] for k in keys]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in made)], [*kept, *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return docs.mapInArrow(rows, f"{ddl}, {', '.join(f'`{c}` long' for c in names)}")
