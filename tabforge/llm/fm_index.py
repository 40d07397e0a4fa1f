"""Benchmark decontamination with an FM-index per training shard.

Texts are cut into words, a shard takes up to ``SHARD`` of them, and its suffixes are sorted by
prefix doubling. The index holds the Burrows-Wheeler transform as a wavelet matrix (one bit plane
per bit of a word's number, with counts every 64 bits), the word counts and the positions of every
``SAMPLE``-th suffix. It is written once, as one Parquet row a shard, and serves any test set.

Test phrases (the windows of the benchmark's items) are searched backwards, a block of phrases at a
time and all phrases of a block at once: each step narrows every phrase's suffix range by two
ranks. Occurrences are located by walking to the next sampled suffix, and the spans found in a
document are merged over its pieces, shards and blocks.

A document lies in the index as pieces of ``PIECE`` words that share ``LONGEST`` - 1 words with the
next, so that a very long document spreads over shards, no phrase is cut, and copies tie for a
bounded number of words. Words are told apart by 64-bit hashes.

Defined results: null, empty or blank text has no words and no hit; an item without words has no
phrase; an item of null id counts as hit but its id is written as an empty string; rows repeated
under one doc_id (or a null one) each get a row; a repeated item_id is one item; empty tables give
no hit or no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SHARD, PIECE, LONGEST, SAMPLE = 1 << 19, 240, 10, 8
#: Phrases sent to the tasks at once, and suffixes located at once.
BLOCK, LOCATE = 200_000, 1 << 18
#: Bytes of text hashed at once.
CHUNK = 8 << 20

_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_LETTER = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_BASE = 0x9E3779B97F4A7C15


# ---- words -------------------------------------------------------------------------------------


def _powers(n: int, base: int, have: list) -> np.ndarray:
    """base^0.. base^(n-1) modulo 2^64, kept in ``have``."""
    if not have or len(have[0]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have[:] = [np.multiply.accumulate(p)]
    return have[0][:n]


_UP: list = []
_DOWN: list = []


def _hash_chunk(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 bytes, and where they start; no word goes over a cut."""
    word = _WORD[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~(word[1:] & word[:-1])
    edge[cuts] = True
    first, last = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers(len(data), _BASE, _UP), out=sums[1:])
    h = (sums[last] - sums[first]) * _powers(len(data), pow(_BASE, -1, 2**64), _DOWN)[first]
    h ^= h >> np.uint64(29)  # the low bits of a sum of odd multiples are weak
    return h * np.uint64(0xBF58476D1CE4E5B9), first


def _between_words(data: np.ndarray, lo: int, hi: int) -> int:
    """The last place up to ``hi`` that follows a byte of no word, or the first one beyond."""
    for reach in (min(hi - lo, 1 << 16), hi - lo):
        gap = np.flatnonzero(~_WORD[data[hi - reach : hi]])
        if len(gap):
            return hi - reach + int(gap[-1]) + 1
    gap = np.flatnonzero(~_WORD[data[hi:]])
    return hi + int(gap[0]) if len(gap) else len(data)


def _mask(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of an Arrow array, and the number of words of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), texts.buffers(), offset=texts.offset)
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(texts) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(texts) else np.empty(0, np.uint8)
    at = at - at[0]
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = _between_words(data, lo, lo + CHUNK) if lo + CHUNK < len(data) else len(data)
        cuts = at[(at >= lo) & (at <= hi)] - lo
        h, first = _hash_chunk(data[lo:hi], cuts)
        hashes.append(h)
        starts.append(first + lo)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), at))


# ---- the index of a shard ----------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of numbers 0.. in which every piece ends in a number of its own. Prefix
    doubling: a rank is the place of a suffix's group; only groups of two or more are sorted on."""
    n = len(t)
    b = max(1, n.bit_length())
    size = np.bincount(t)
    rank = (np.cumsum(size) - size)[t]
    act, h = np.flatnonzero(size[t] > 1), 1
    while len(act):
        key = np.sort((((rank[act] << b) | rank[act + h]) << b) | act)
        at, key = key & ((1 << b) - 1), key >> b
        group = key >> b
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        place = np.arange(len(key))
        head = np.maximum.accumulate(np.where(new[:-1], place, 0))
        old = np.ones(len(key), bool)
        old[1:] = group[1:] != group[:-1]
        rank[at] = group + head - np.maximum.accumulate(np.where(old, place, 0))
        act = at[~(new[:-1] & new[1:])]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class Wavelet:
    """A sequence as bit planes, highest bit first, each plane sorted by the bits above it."""

    def __init__(self, planes: np.ndarray, n: int, counts: np.ndarray):
        self.planes, self.n, self.counts = planes, n, counts
        self.ones = np.zeros(planes.shape, np.int64)
        np.cumsum(np.bitwise_count(planes[:, :-1]), axis=1, out=self.ones[:, 1:])
        self.levels = len(planes)
        self.zeros = n - self._rank(np.arange(self.levels), np.full(self.levels, n))
        # where each symbol's run starts below the last plane: symbols by reversed bits
        sym = np.arange(len(counts))
        reverse = np.zeros_like(sym)
        for j in range(self.levels):
            reverse = (reverse << 1) | ((sym >> j) & 1)
        order = np.argsort(reverse)
        self.start = np.empty(len(counts), np.int64)
        self.start[order] = np.cumsum(counts[order]) - counts[order]

    @staticmethod
    def of(seq: np.ndarray, symbols: int) -> np.ndarray:
        """The bit planes of a sequence of numbers below ``symbols``, as 64-bit words."""
        levels = max(1, (symbols - 1).bit_length())
        planes = np.zeros((levels, len(seq) // 64 + 1), np.uint64)
        for j in range(levels):
            bit = (seq >> (levels - 1 - j)) & 1
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            planes[j].view(np.uint8)[: len(raw)] = raw
            one = bit.astype(bool)
            seq = np.concatenate([seq[~one], seq[one]])
        return planes

    def _rank(self, level, i):
        """Ones before place i of a plane."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.ones[level, word] + np.bitwise_count(self.planes[level, word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        for j in range(self.levels):
            one = self._rank(j, i)
            i = np.where((symbol >> (self.levels - 1 - j)) & 1, self.zeros[j] + one, i - one)
        return i - self.start[symbol]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place i, and its rank there."""
        symbol = np.zeros_like(i)
        for j in range(self.levels):
            bit = (self.planes[j, i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            one = self._rank(j, i)
            i = np.where(bit == 1, self.zeros[j] + one, i - one)
            symbol = (symbol << 1) | bit.astype(np.int64)
        return symbol, i - self.start[symbol]


class Index:
    """FM-index of a shard. Symbol 0 ends a piece; word k of the sorted ``vocab`` is symbol k + 1."""

    FIELDS = ["n", "vocab", "counts", "planes", "marks", "samples", "starts"]
    DDL = "n long, vocab binary, counts binary, planes binary, marks binary, samples binary, starts binary"

    def __init__(self, n: int, vocab: bytes, counts: bytes, planes: bytes, marks: bytes, samples: bytes, starts: bytes):
        self.n, self.vocab = n, np.frombuffer(vocab, "<u8")
        counts = np.frombuffer(counts, "<i4").astype(np.int64)
        self.first = np.cumsum(counts) - counts
        self.bwt = Wavelet(np.frombuffer(planes, "<u8").reshape(-1, n // 64 + 1), n, counts)
        marks = np.frombuffer(marks, "<u8").reshape(1, -1)
        self.marks = Wavelet(marks, n, np.array([n, 0]))
        self.samples, self.starts = np.frombuffer(samples, "<i4"), np.frombuffer(starts, "<i4")

    @staticmethod
    def build(hashes: np.ndarray, sizes: np.ndarray) -> list:
        """The stored fields of an index over pieces of ``sizes`` words each."""
        order = np.argsort(hashes)
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        number = np.empty(len(hashes), np.int64)
        number[order] = np.cumsum(new) - 1
        vocab = hashes[order][new]
        pieces, n = len(sizes), len(hashes) + len(sizes)
        starts = np.cumsum(sizes + 1) - sizes - 1
        is_end = _mask(n, starts + sizes)
        t = np.empty(n, np.int64)
        t[is_end] = np.arange(pieces)
        t[~is_end] = number + pieces
        sa = suffix_array(t)
        symbol = np.where(is_end, 0, t - pieces + 1).astype(np.int32)
        planes = Wavelet.of(symbol[sa - 1], len(vocab) + 1)
        # every SAMPLE-th suffix and those that start a piece, where a walk would leave it
        sampled = (sa % SAMPLE == 0) | _mask(n, starts)[sa]
        marks = np.zeros(n // 64 + 1, np.uint64)
        raw = np.packbits(sampled.astype(np.uint8), bitorder="little")
        marks.view(np.uint8)[: len(raw)] = raw
        counts = np.bincount(symbol, minlength=len(vocab) + 1)
        made = (vocab.astype("<u8"), counts.astype("<i4"), planes, marks, sa[sampled].astype("<i4"), starts.astype("<i4"))
        return [n, *(x.tobytes() for x in made)]

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from, to): the suffix ranges of the phrases that occur. ``phrases`` holds word
        hashes, a phrase's last word in the last column."""
        at = np.minimum(np.searchsorted(self.vocab, phrases), max(len(self.vocab) - 1, 0))
        known = (self.vocab[at] == phrases) if len(self.vocab) else np.zeros(phrases.shape, bool)
        width = phrases.shape[1]
        live = np.flatnonzero((known | (np.arange(width) < width - sizes[:, None])).all(1))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        done = [(live[:0], lo[:0], hi[:0])]
        for k in range(width):
            over = sizes[live] == k
            done.append((live[over], lo[over], hi[over]))
            live, lo, hi = live[~over], lo[~over], hi[~over]
            if not len(live):
                break
            symbol = at[live, width - 1 - k] + 1
            lo, hi = self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
        done.append((live, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        out, at, left, steps = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(at):
            here = (self.marks.planes[0, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[here]] = self.samples[self.marks._rank(0, at[here])] + steps
            left, at = left[~here], at[~here]
            symbol, rank = self.bwt.read(at)
            at, steps = self.first[symbol] + rank, steps + 1
        return out

    def find(self, phrases: np.ndarray, sizes: np.ndarray):
        """Yields (phrase, piece, place in the piece) of all occurrences, in bounded parts."""
        phrase, lo, hi = self.ranges(phrases, sizes)
        upto = np.cumsum(hi - lo)
        total = int(upto[-1]) if len(upto) else 0
        for a in range(0, total, LOCATE):
            k = np.arange(a, min(total, a + LOCATE))
            which = np.searchsorted(upto, k, "right")
            at = self.locate(hi[which] - (upto[which] - k))
            piece = np.searchsorted(self.starts, at, "right") - 1
            yield phrase[which], piece, at - self.starts[piece]


# ---- Spark -------------------------------------------------------------------------------------


def build_index(docs: DataFrame, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """Staged: one row a shard (of about ``shard`` words) with its index and, per piece, the row
    (uid), doc_id, first word and own words (``owned``, those the next piece does not hold)."""
    kind = dict(docs.dtypes)["doc_id"]
    names = [*Index.FIELDS, "uid", "doc_id", "place", "owned"]

    def rows(batches):
        held: list[tuple] = []
        room = shard

        def flush():
            hashes, sizes, uid, doc, place, owned = zip(*held, strict=True)
            made = Index.build(np.concatenate(hashes), np.concatenate(sizes))
            lists = [np.concatenate(uid), pa.concat_arrays(doc), np.concatenate(place), np.concatenate(owned)]
            cols = [pa.array([made[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in made[1:])]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x) for x in lists]
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            hashes, n = text_words(b.column(2))
            begin = np.cumsum(n) - n
            pieces = np.maximum(1, -(-n // piece))
            row = np.repeat(np.arange(len(n)), pieces)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
            owned = np.minimum(n[row] - place, piece)
            sizes = np.minimum(n[row] - place, piece + LONGEST - 1)
            uid, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            lo, ends = 0, np.cumsum(sizes + 1)
            while lo < len(row):
                base = ends[lo - 1] if lo else 0
                hi = max(lo + (room == shard), int(np.searchsorted(ends, base + room, "right")))
                if hi > lo:
                    r, k = row[lo:hi], sizes[lo:hi]
                    first = np.cumsum(k) - k
                    take = np.arange(k.sum()) + np.repeat(begin[r] + place[lo:hi] - first, k)
                    held.append((hashes[take], k, uid[r], ids.take(pa.array(r)), place[lo:hi], owned[lo:hi]))
                    room -= int(ends[hi - 1] - base)
                    lo = hi
                if lo < len(row):
                    yield flush()
                    held, room = [], shard
        if held:
            yield flush()

    ddl = f"{Index.DDL}, uid array<long>, doc_id array<{kind}>, place array<long>, owned array<long>"
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return stage(numbered.mapInArrow(rows, ddl), "fm-index")


def phrase_blocks(items: DataFrame, window: int = LONGEST):
    """Yields (phrases, sizes, of, names): distinct windows of the items' words as rows of hashes,
    last word last, at most ``BLOCK`` at a time, and the item names that have them, as lists by
    offset. Items are cut on Spark and drawn as a stream, so the driver holds one block."""
    if window > LONGEST:
        raise ValueError(f"the index finds phrases of up to {LONGEST} words, not {window}")

    def cut(batches):
        for b in batches:
            hashes, n = text_words(b.column(1))
            count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
            row = np.repeat(np.arange(len(n)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (np.cumsum(n) - n)[row]
            size = np.minimum(n[row], window)
            words = [hashes[a : a + k].astype("<u8").tobytes() for a, k in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(words, pa.binary())], ["item", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    cuts = named.mapInArrow(cut, "item string, words binary")
    by_words = stage(cuts.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-windows")

    def block(rows):
        sizes = np.array([len(r["words"]) // 8 for r in rows], np.int64)
        phrases = np.zeros((len(rows), window), np.uint64)
        for k, r in enumerate(rows):
            phrases[k, window - sizes[k] :] = np.frombuffer(r["words"], "<u8")
        names = sorted({i for r in rows for i in r["items"]})
        number = {x: k for k, x in enumerate(names)}
        of = [np.array([number[i] for i in r["items"]], np.int64) for r in rows]
        return phrases, sizes, of, names

    held = []
    for r in by_words.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield block(held)
            held = []
    if held:
        yield block(held)


def search(index: DataFrame, phrases: np.ndarray, sizes: np.ndarray, of: list, names: list[str]) -> DataFrame:
    """uid, doc_id, spans (start, end in words), items: of every piece that a phrase occurs in."""
    kind = dict(index.dtypes)["doc_id"].removeprefix("array<")[:-1]

    def rows(batches):
        for b in batches:
            for k in range(b.num_rows):
                shard = Index(*(b.column(c)[k].as_py() for c in range(len(Index.FIELDS))))
                hits = [np.empty((3, 0), np.int64), *(np.stack(x) for x in shard.find(phrases, sizes))]
                phrase, piece, at = np.concatenate(hits, axis=1)
                if not len(piece):
                    continue
                uid, doc, place = (b.column(name)[k].values for name in ("uid", "doc_id", "place"))
                order = np.lexsort((at, piece))
                phrase, piece, at = phrase[order], piece[order], at[order]
                begin = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
                spans, items = [], []
                for lo, hi in zip(begin, np.r_[begin[1:], len(piece)], strict=True):
                    base = place[int(piece[lo])].as_py()
                    spans.append(merge(at[lo:hi] + base, at[lo:hi] + base + sizes[phrase[lo:hi]]))
                    items.append([names[i] for i in np.unique(np.concatenate([of[p] for p in np.unique(phrase[lo:hi])]))])
                which = pa.array(piece[begin])
                cols = [uid.take(which), doc.take(which), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "spans", "items"])

    return index.drop("owned").mapInArrow(rows, f"uid long, doc_id {kind}, spans array<struct<start:bigint,end:bigint>>, items array<string>")


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def merge(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Spans in ascending order, those that touch or overlap made one. ``start`` ascends."""
    upto = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > upto[:-1]])
    stop = upto[np.r_[new[1:] - 1, len(start) - 1]]
    return [{"start": int(a), "end": int(z)} for a, z in zip(start[new], stop, strict=True)]


def hit_spans(docs: DataFrame, items: DataFrame, window: int = LONGEST, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """Per document: doc_id, n_words, spans of words inside occurrences (merged, ascending), items
    (their names, ascending as strings)."""
    index = build_index(docs, shard, piece)
    one = index.select(F.explode(F.arrays_zip("uid", "doc_id", "owned")).alias("p")).select("p.*")
    parts = one.select("uid", "doc_id", F.col("owned").alias("n"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for phrases, sizes, of, names in phrase_blocks(items, window):
        parts = parts.unionByName(search(index, phrases, sizes, of, names).withColumn("n", F.lit(0).cast("long")))
    each = parts.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def meet(batches):
        # pieces hand in merged spans; those of neighbouring pieces and of other blocks still meet
        for b in batches:
            flat, at = b.column(2).values, b.column(2).offsets.to_numpy()
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            spans = [merge(start[i:j], end[i:j]) if j > i else [] for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(_SPAN)), b.column(3)], b.schema.names)

    kind = dict(docs.dtypes)["doc_id"]
    return each.select("doc_id", "n_words", "spans", "items").mapInArrow(meet, f"doc_id {kind}, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = LONGEST, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """``hit_spans`` as counts and digests: n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    h = hit_spans(docs, items, window, shard, piece).withColumn("n_hit", n_hit)
    return h.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
