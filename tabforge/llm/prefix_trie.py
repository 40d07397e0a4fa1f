"""Prefix trie of conversations from sorted neighbours.

Conversations are sorted as sequences of turn keys. Neighbours in that order are joined by an edge
of the number of first turns they share; union-find takes a task's edges in descending depth, and
every merge of two components makes (or widens) the branching node at that depth, while the turns
between a component's node and the merge are nodes of one child each. What a task cannot decide
alone, the nodes on the paths of its first and last conversation, is contracted: per node only
counts of what hangs below. These spines are merged across the boundaries of tasks: a boundary's
depth and a task's least inner edge (two numbers a task) say in which task a node begins, partial
counts meet by (that task, side, depth), and sums over subtrees are differences of running totals
in pre-order.

Turns are compared by 128-bit keys. A conversation's keys are one row (16 bytes a turn); its turns
are ordered by range slices, so a conversation of any share of all rows is not sorted in one task.

Defined results: a null role or text is empty; turns are ordered by turn (null first), role and
text; rows repeated are turns of their own; rows without conv_id belong to no conversation and are
left out; an empty table gives no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_total, shuffle_partitions, stage, unstage

#: Conversation c begins with the first crc32(c) % SHARED turns of conversation c - c % FAMILY.
SHARED, FAMILY = 6, 100
NODE, SPINE, EDGE = 0, 1, 2
#: A spine node covers all rows of its task, or only the first or the last ones.
BOTH, LEFT, RIGHT = 0, 1, 2
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- conversations as sequences ------------------------------------------------------------------


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Staged: conv_id, pos (from 1), k1, k2 (key of role and text), chars."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]

    def number(batches):
        from pyspark import TaskContext

        pid, last, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column(0).to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            new = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
            k = np.arange(len(conv))
            pos = k - np.maximum.accumulate(np.where(new, k, -1)) + 1
            head = int(np.argmax(new)) if new.any() else len(conv)
            pos[:head] = k[:head] + at + 1  # the rows before the first new one go on from the last batch
            last, at = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos), pa.array(np.full(len(conv), pid, np.int32))], [*b.schema.names, "local", "pid"])

    sliced = t.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    keyed = sliced.select("conv_id", F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "role").alias("k2"), F.length("text").cast("long").alias("chars"))
    out = stage(keyed.mapInArrow(number, "conv_id long, k1 long, k2 long, chars long, local long, pid int"), "turn-keys")
    # conversations that go over the edge of a slice: fewer than slices
    cut = out.groupBy("conv_id").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).filter("lo < hi").select("conv_id")
    sizes = out.join(F.broadcast(cut), "conv_id").groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("n")).collect()
    before, rows = {}, []
    for r in sorted(sizes, key=lambda r: (r["conv_id"], r["pid"])):
        rows.append((r["conv_id"], r["pid"], before.get(r["conv_id"], 0)))
        before[r["conv_id"]] = rows[-1][2] + r["n"]
    offsets = turns.sparkSession.createDataFrame(rows, "conv_id long, pid int, off long")
    joined = out.join(F.broadcast(offsets), ["conv_id", "pid"], "left")
    return joined.select("conv_id", (F.coalesce("off", F.lit(0)) + F.col("local")).alias("pos"), "k1", "k2", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Staged: conv_id, keys (two 64-bit numbers a turn), chars of every rebuilt conversation."""
    t = ordered_turns(turns)
    turn = F.struct("pos", "k1", "k2", "chars")
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    donors = t.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED)).groupBy(F.col("conv_id").alias("donor"))
    donors = donors.agg(F.sort_array(F.collect_list(turn)).alias("lent"))  # fewer than SHARED turns each
    own = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos") > share, turn))).alias("own"))
    own = own.withColumns({"donor": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": share.cast("int")})
    lent = F.when(F.col("lent").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("lent", F.lit(1), F.col("h")))
    seq = own.join(donors, "donor", "left").select("conv_id", F.concat(lent, "own").alias("s"))
    keys = F.flatten(F.transform("s", lambda x: F.array(x["k1"], x["k2"])))
    return stage(seq.select("conv_id", keys.alias("keys"), F.transform("s", lambda x: x["chars"]).alias("chars")), "rebuilt")


# ---- the forest of one task ----------------------------------------------------------------------


class Forest:
    """Union-find over the sorted conversations of one task. A component is a run of rows, known by
    its first one; ``top`` is the depth of its highest node yet."""

    def __init__(self, convs: list[int], lcp: np.ndarray, sizes: np.ndarray, fresh: list[np.ndarray]):
        """``lcp[i]``: turns that row i shares with row i - 1; ``fresh[i]``: chars of its others."""
        n = len(convs)
        self.convs, self.lcp, self.fresh, self.last = convs, lcp.tolist(), fresh, n - 1
        self.root, self.hi, self.low = list(range(n)), list(range(n)), list(convs)
        self.top, self.kids, self.ending = sizes.tolist(), [0] * n, [1] * n
        self.leaves, self.saved = [0] * n, [0] * n
        self.refs: list[list[int]] = [[] for _ in range(n)]
        self.rows: list[list] = []
        for i in (np.argsort(-lcp[1:], kind="stable") + 1).tolist():
            self.join(self.find(i - 1), i, self.lcp[i])
        self.close(0, -1)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(self, a: int, b: int, depth: int) -> None:
        """Merge two neighbouring components: they meet in a node of that depth."""
        for c in (a, b):
            if self.top[c] > depth:
                self.close(c, depth)
                self.top[c], self.kids[c], self.ending[c] = depth, 1, 0
        self.root[b], self.hi[a], self.low[a] = a, self.hi[b], min(self.low[a], self.low[b])
        self.kids[a] += self.kids[b]
        self.ending[a] += self.ending[b]
        self.leaves[a] += self.leaves[b]
        self.saved[a] += self.saved[b]
        self.refs[a] += self.refs[b]
        self.refs[b] = []

    def close(self, a: int, depth: int) -> None:
        """Write the nodes of component ``a`` that are deeper than ``depth``, deepest first."""
        hi, conv, count, known = self.hi[a], self.low[a], self.hi[a] - a + 1, self.lcp[a]
        left, right = a == 0, hi == self.last
        side = BOTH if left and right else LEFT if left else RIGHT if right else None
        kids, ending = self.kids[a], self.ending[a]
        for d in range(self.top[a], depth, -1):
            chars = int(self.fresh[a][d - 1 - known]) if d else 0
            ends = ",".join(map(str, self.convs[a : a + ending])) if ending else ""
            for r in self.refs[a]:
                self.rows[r][4 if side is None else 5] = conv if side is None else side
            if side is None:
                self.saved[a] += (count - 1) * chars
                self.leaves[a] += kids == 0
                digest = hashlib.sha256(ends.encode()).hexdigest() if ending else _NO_ENDS
                self.rows.append([NODE, None, conv, d, None, None, count, kids, self.leaves[a], self.saved[a], None, digest])
                self.refs[a] = [len(self.rows) - 1]
            else:
                self.rows.append([SPINE, side, conv, d, None, None, count, kids, self.leaves[a], self.saved[a], chars, ends])
                self.leaves[a], self.saved[a], self.refs[a] = 0, 0, []
            kids, ending = 1, 0


_COLUMNS = ["kind", "side", "conv_id", "depth", "parent_conv_id", "parent_side", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends"]
_TYPES = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 5, pa.string()]
_DDL = "kind int, side int, conv_id long, depth long, parent_conv_id long, parent_side int, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"


def _task_forest(batches) -> Iterator[pa.RecordBatch]:
    """The nodes, spine nodes and the edge row (first and last keys, least inner lcp as depth) of a
    task's rows, which come sorted by (keys, conv_id)."""
    from pyspark import TaskContext

    pid, convs, lcp, sizes, fresh = TaskContext.get().partitionId(), [], [], [], []
    first = last = np.empty(0, np.int64)
    for b in batches:
        keys, chars = b.column(1), b.column(2)
        flat, at = keys.values.to_numpy(zero_copy_only=False), keys.offsets.to_numpy()
        flat_chars, at_chars = chars.values.to_numpy(zero_copy_only=False), chars.offsets.to_numpy()
        convs += b.column(0).to_pylist()
        for i in range(b.num_rows):
            k = flat[at[i] : at[i + 1]]
            m = min(len(k), len(last))
            differ = np.flatnonzero(k[:m] != last[:m])
            shared = (int(differ[0]) if len(differ) else m) // 2 if sizes else 0
            first = first if sizes else k.copy()
            lcp.append(shared)
            sizes.append(len(k) // 2)
            fresh.append(flat_chars[at_chars[i] + shared : at_chars[i + 1]].copy())
            last = k
        last = last.copy()
    if not sizes:
        return
    rows = Forest(convs, np.array(lcp), np.array(sizes), fresh).rows
    names = [*_COLUMNS, "pid", "first", "last"]
    for lo in range(0, len(rows), 10_000):
        part = rows[lo : lo + 10_000]
        cols = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TYPES, strict=True)]
        none = pa.nulls(len(part), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*cols, pa.array([pid] * len(part), pa.int32()), none, none], names)
    edge = [EDGE, None, None, min(lcp[1:], default=sizes[0]), *[None] * 8]
    cols = [pa.array([v], t) for v, t in zip(edge, _TYPES, strict=True)]
    ends = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (first, last)]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([pid], pa.int32()), *ends], names)


# ---- merging across tasks ------------------------------------------------------------------------


def _boundaries(parts: DataFrame) -> DataFrame:
    """pid, least (inner lcp), shared (lcp with the task before, -1 for the first), stairs: the tasks
    before it, nearest last, with less and less reach, as (reach, q, least). A node of depth d that
    comes in from the left begins in the last q of reach < d. A few numbers a task reach the driver."""
    edges = parts.filter(F.col("kind") == EDGE).select("pid", F.col("depth").alias("least"), "first", "last")
    before = F.lag("last").over(Window.orderBy("pid"))  # one row a task
    same = F.zip_with("first", "before", lambda x, y: x == y)
    place = F.array_position(same, F.lit(False))
    n = F.least(F.size("first"), F.size("before"))
    shared = F.when(F.col("before").isNull(), -1).otherwise(F.floor(F.when(place == 0, n).otherwise(place - 1) / 2)).cast("long")
    rows, stack = [], []
    for r in sorted(edges.withColumn("before", before).select("pid", "least", shared.alias("shared")).collect(), key=lambda r: r["pid"]):
        reach = min(r["least"], r["shared"])
        rows.append((r["pid"], r["least"], r["shared"], [x for x in stack if x[0] < r["shared"]]))
        while stack and stack[-1][0] >= reach:
            stack.pop()
        stack.append((reach, r["pid"], r["least"]))
    return parts.sparkSession.createDataFrame(rows, "pid int, least long, shared long, stairs array<struct<reach:long,q:int,least:long>>")


def _identity(side: Column, depth: Column) -> Column:
    """(task, side) in which the node begins that a task has at that side and depth."""
    comes_in = (side != RIGHT) & (F.col("shared") >= depth)
    nearer = F.filter("stairs", lambda x: x["reach"] < depth)
    at = F.get(nearer, F.size(nearer) - 1)
    there = F.struct(at["q"].alias("task"), F.when(depth <= at["least"], BOTH).otherwise(RIGHT).alias("side"))
    return F.when(comes_in, there).otherwise(F.struct(F.col("pid").alias("task"), side.alias("side")))


def _digests(pieces: DataFrame) -> DataFrame:
    """task, begins, depth, ends_sha256 of the joined pieces in task order, as a stream."""
    keys = ["task", "begins", "depth"]

    def rows(batches):
        last, digest = None, None
        for b in batches:
            out = []
            for *key, ends in zip(*(b.column(c).to_pylist() for c in (*keys, "ends")), strict=True):
                if key == last:
                    digest.update(b"," + ends.encode())
                else:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(ends.encode())
            yield batch(out)
        if last is not None:
            yield batch([(*last, digest.hexdigest())])

    def batch(out):
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [*keys, "ends_sha256"])

    dealt = pieces.repartition(shuffle_partitions(pieces.sparkSession), *keys).sortWithinPartitions(*keys, "pid")
    return dealt.select(*keys, "ends").mapInArrow(rows, "task int, begins int, depth long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """task, begins, depth, saved_tokens, n_leaves: own weights summed over the merged spines below.
    In pre-order (task, side, depth) a subtree is a run, so its sum is a difference of totals."""
    key = ["task", "begins", "depth"]
    opens = nodes.select(*key, F.col("task").alias("o_task"), F.col("begins").alias("o_side"), F.lit(0).alias("closes"), "w_saved", "w_leaves")
    ends_left = F.when(F.col("last_side") == LEFT, LEFT).otherwise(RIGHT)
    zero = F.lit(0).cast("long")
    closes = nodes.select(*key, F.col("last_task").alias("o_task"), ends_left.alias("o_side"), F.lit(1).alias("closes"), zero.alias("w_saved"), zero.alias("w_leaves"))
    order = ["o_task", "o_side", "closes", "depth", "task", "begins"]
    n = shuffle_partitions(nodes.sparkSession)
    run = opens.unionByName(closes)
    run = running_total(run, order, "w_saved", "trie-saved", n).withColumnRenamed("start", "s")
    run = running_total(run, order, "w_leaves", "trie-leaves", n).withColumnRenamed("start", "l")
    between = lambda c: F.max(F.when(F.col("closes") == 1, F.col(c))) - F.max(F.when(F.col("closes") == 0, F.col(c)))
    return run.groupBy(*key).agg(between("s").alias("saved_tokens"), between("l").alias("n_leaves"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    seqs = rebuilt(turns)
    n = shuffle_partitions(turns.sparkSession)
    parts = seqs.repartitionByRange(n, "keys", "conv_id").sortWithinPartitions("keys", "conv_id").select("conv_id", "keys", "chars")
    parts = stage(parts.mapInArrow(_task_forest, f"{_DDL}, pid int, first array<long>, last array<long>"), "trie-parts")
    unstage(seqs)
    edges = F.broadcast(_boundaries(parts))  # one row a task
    parts = parts.drop("first", "last")

    depth, side = F.col("depth"), F.col("side")
    above = F.when(depth - 1 <= F.col("least"), BOTH).otherwise(side)
    twice = ((side != RIGHT) & (F.col("shared") > depth)).cast("long")  # a child that comes in too is counted before
    spine = parts.filter(F.col("kind") == SPINE).join(edges, "pid").withColumns({"at": _identity(side, depth), "parent": _identity(above, depth - 1)})
    spine = spine.select("*", F.col("at.task").alias("task"), F.col("at.side").alias("begins"))
    nodes = spine.groupBy("task", "begins", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum(F.col("n_children") - twice).alias("n_children"),
        F.sum("saved_tokens").alias("inner_saved"), F.sum("n_leaves").alias("inner_leaves"), F.max("chars").alias("chars"),
        F.min_by("parent", "pid").alias("parent"), F.max("pid").alias("last_task"), F.max_by("side", "pid").alias("last_side"),
    )
    w_saved = F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("chars")
    w_leaves = F.col("inner_leaves") + (F.col("n_children") == 0).cast("long")
    nodes = stage(nodes.withColumns({"w_saved": w_saved, "w_leaves": w_leaves}), "trie-spines")
    digests = stage(_digests(spine.filter("ends <> ''").select("task", "begins", "depth", "pid", "ends")), "trie-ends")
    key = ["task", "begins", "depth"]
    whole = nodes.select(*key, "conv_id", "n_convs", "n_children", "parent").join(_subtree_sums(nodes), key).join(digests, key, "left")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    own = nodes.select(F.struct("task", F.col("begins").alias("side")).alias("parent"), (depth + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(own, ["parent", "depth"], "left").select(*shown)
    inner = parts.filter(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    known = inner.filter("parent_conv_id is not null").select(*shown)
    hanging = inner.filter("parent_conv_id is null").join(edges, "pid").withColumn("parent", _identity(F.col("parent_side"), depth - 1))
    hanging = hanging.drop("parent_conv_id").join(own, ["parent", "depth"]).select(*shown)
    return whole.unionByName(known).unionByName(hanging)
