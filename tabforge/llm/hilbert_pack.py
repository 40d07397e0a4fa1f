"""Sequence packing along a space-filling curve.

A document's token counts are hashed with signs into ``HASHED`` places, scaled to length 1 and
projected to ``DIMS`` dimensions by a fixed Gaussian matrix. Each dimension is scaled by its mean
and deviation over the whole corpus, cut into 2^``BITS`` steps and mapped to a Hilbert key. Rows
are range-sorted by (key, row), so neighbours on the curve follow each other and equal documents
split over tasks; the running sum of tokens in that order gives every document its place in one
stream, cut at multiples of ``LENGTH``. Only the last sequence of all can be short; it needs no
more than padding to the next power of two.

The token table is staged once; only (row, key, count) is sorted, and the ids meet their place by
one join on the row.

Defined results: null or empty text is the end token alone; repeated rows are packed each; a null
doc_id is packed like any other; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, running_total, shuffle_partitions, stage
from .token_library import text_encoder

LENGTH = 1024
HASHED, DIMS, BITS = 256, 4, 15
#: Documents projected at once.
AT_ONCE = 512
END_ID = 0
_PROJECT = np.random.default_rng(7).standard_normal((HASHED, DIMS)).astype(np.float32)


@lru_cache(maxsize=2)
def _hashed(vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of every token id."""
    h = np.arange(vocab, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return ((h >> np.uint64(48)) % np.uint64(HASHED)).astype(np.int64), sign


def project(ids: np.ndarray, n_tokens: np.ndarray, vocab: int) -> np.ndarray:
    """Places in ``DIMS`` dimensions of documents whose token ids follow each other."""
    place, sign = _hashed(vocab)
    out = np.empty((len(n_tokens), DIMS), np.float32)
    ends = np.cumsum(n_tokens)
    for lo in range(0, len(n_tokens), AT_ONCE):
        n = n_tokens[lo : lo + AT_ONCE]
        part = ids[ends[lo] - n[0] : ends[lo + len(n) - 1]]
        cell = place[part] + np.repeat(np.arange(len(n)) * HASHED, n)
        v = np.bincount(cell, weights=sign[part], minlength=len(n) * HASHED).reshape(len(n), HASHED)
        out[lo : lo + len(n)] = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32) @ _PROJECT
    return out


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows of ``x``, each coordinate below 2^bits): the
    coordinates are turned into the transposed index bit plane by bit plane, then interleaved."""
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_XS = [f"x{i}" for i in range(DIMS)]


def token_rows(batches, path: str, end_id: int):
    """doc_id, n_tokens, x0.., ids of (doc_id, text) rows. A piece of a batch at a time: the ids and
    lists of a whole batch stayed in the worker's memory through all later steps."""
    enc = text_encoder(path)
    vocab = enc.tok.get_vocab_size()
    small = np.uint16 if vocab <= 1 << 16 else np.uint32
    for b in by_bytes(batches, 1):
        ids, n = enc.encode_batch(b.column(1), end_id)
        p = project(ids, n, vocab).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(n)]) * np.dtype(small).itemsize
        raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype(small))])
        cols = [b.column(0), pa.array(n, pa.int64()), *[pa.array(p[:, i]) for i in range(DIMS)], raw.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *_XS, "ids"])


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Staged: doc_id, n_tokens (with the end id), x0.. (place), ids (bytes), uid (row)."""
    d = docs.select("doc_id", "text")
    ddl = f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, {', '.join(f'{x} double' for x in _XS)}, ids binary"
    made = d.mapInArrow(lambda batches: token_rows(batches, path, end_id), ddl)
    return stage(made.withColumn("uid", F.monotonically_increasing_id()), "pack-tokens")


def curve_keys(tokens: DataFrame) -> DataFrame:
    """uid, key, n_tokens: the Hilbert key of every row of a token table."""
    xs = _XS
    s = tokens.agg(*[f(x).alias(f"{f.__name__}_{x}") for x in xs for f in (F.avg, F.stddev_pop)]).collect()[0]
    mean = np.array([s[f"avg_{x}"] or 0.0 for x in xs])
    dev = np.array([s[f"stddev_pop_{x}"] or 1.0 for x in xs])

    def rows(batches):
        for b in batches:
            p = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in xs], 1)
            steps = np.floor((np.tanh((p - mean) / dev * 0.6) + 1) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(hilbert_keys(steps)), b.column("n_tokens")], ["uid", "key", "n_tokens"])

    return tokens.select("uid", "n_tokens", *xs).mapInArrow(rows, "uid long, key long, n_tokens long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start (in the document), piece_length, doc_tokens, sequence_id,
    offset (in the sequence), ids (little-endian 32-bit)."""
    tokens = token_table(docs, path, end_id)
    placed = running_total(curve_keys(tokens), ["key", "uid"], "n_tokens", "pack-places", shuffle_partitions(docs.sparkSession))
    whole = tokens.select("uid", "doc_id", "ids", "n_tokens").join(placed.select("uid", F.col("start").alias("at")), "uid")

    ids_at = whole.columns.index("ids")

    def cut(batches):
        for b in by_bytes(batches, ids_at):
            out: list[list] = [[] for _ in range(7)]
            for doc, raw, n, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n_tokens", "at")), strict=True):
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                lo = 0
                while lo < n:
                    k = min(n - lo, length - (at + lo) % length)
                    for col, v in zip(out, (doc, lo, k, n, (at + lo) // length, (at + lo) % length, wide[lo : lo + k].tobytes()), strict=True):
                        col.append(v)
                    lo += k
            kinds = [b.schema.field("doc_id").type, *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    names = ["doc_id", "start", "piece_length", "doc_tokens", "sequence_id", "offset", "ids"]
    kind = dict(tokens.dtypes)["doc_id"]
    return whole.mapInArrow(cut, f"doc_id {kind}, start long, piece_length long, doc_tokens long, sequence_id long, offset long, ids binary")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces without their ids, each with the crc32 of its ids."""
    return pieces.select(
        "doc_id", "start", F.col("piece_length").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The packed rows themselves: sequence_id, input_ids (bytes, 32-bit), n_tokens, n_padding.
    A sequence is padded to ``length``, except that the last may end at a power of two."""
    s = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("piece_length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    to = F.least(F.lit(length), F.pow(F.lit(2), F.ceil(F.log2("n_tokens"))).cast("long"))
    return s.select("sequence_id", ids.alias("input_ids"), "n_tokens", (to - F.col("n_tokens")).alias("n_padding"))

