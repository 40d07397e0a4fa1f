"""Token ids as Parquet list columns, one file per run of ascending doc_id.

Runs are cut at percentiles of doc_id, so file k holds smaller ids than file k + 1 and rows ascend
inside a file. The ids are a list column with a dictionary per row group (or delta encoding), row
groups and pages have a set size, and the writer leaves column and offset indexes, so a reader can
take metadata without tokens, or the pages of one id range. A row stores where its tokens start
inside its file (``file_start``); the files' totals give the start over all.

Defined results: null or empty text is the end id alone; rows repeated under one doc_id follow
each other; a null doc_id comes first; an empty table gives empty files; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import ensure_checkpoint_dir

from .common import shuffle_partitions
from .token_library import text_encoder

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 16 << 20, 256 << 10, 1 << 20
_LOWEST = -(2**63)


def _runs(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ascending ids that cut the table into runs of about equal rows."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    shares = [i / n for i in range(1, n)] or [0.5]
    return sorted(set(docs.agg(F.percentile_approx(k, shares, 10 * n).alias("e")).collect()[0]["e"] or []))


def write_tokens(
    docs: DataFrame,
    out: str,
    path: str,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    files: int | None = None,
) -> None:
    """Write doc_id, n_tokens, file_start, ids to the folder ``out``. ``encoding`` is "dictionary"
    or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    spark = docs.sparkSession
    cuts = _runs(docs, files or shuffle_partitions(spark))

    def rows(batches):
        enc, at = text_encoder(path), 0
        for b in batches:
            ids, n = enc.encode_batch(b.column(1), end_id)
            ends = np.cumsum(n) + at
            at = int(ends[-1]) if len(ends) else at
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(ends - n), lists], ["doc_id", "n_tokens", "file_start", "ids"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.lit(_LOWEST))
    if cuts:
        bounds = F.array(*[F.lit(int(e)).cast("long") for e in cuts])
        run = F.size(F.filter(bounds, lambda e: e <= key))
    else:
        run = F.lit(0)
    d = d.withColumn("run", run).repartitionById(len(cuts) + 1, F.col("run")).sortWithinPartitions("run", F.asc_nulls_first("doc_id"), "text")
    made = d.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, file_start long, ids array<int>")
    w = made.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
    w = w.option("maxRecordsPerFile", 0)  # a file is a run: file_start counts from its first row
    w = w.option("parquet.page.size", PAGE_BYTES).option("parquet.dictionary.page.size", DICTIONARY_BYTES)
    w = w.option("parquet.writer.version", "v2" if encoding == "delta" else "v1").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
    w.parquet(out)


def file_starts(spark: SparkSession, out: str) -> DataFrame:
    """file, before: tokens in all files before it (files in name order). Reads the counts alone;
    one row per file reaches the driver."""
    n = spark.read.parquet(out).select("n_tokens", "_metadata.file_name").groupBy("file_name").agg(F.sum("n_tokens").alias("n"))
    rows, at = [], 0
    for r in sorted(n.collect(), key=lambda r: r["file_name"]):
        rows.append((r["file_name"], at))
        at += r["n"]
    return spark.createDataFrame(rows, "file_name string, before long")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids."""
    t = spark.read.parquet(out).select("doc_id", "n_tokens", "file_start", "ids", "_metadata.file_name")
    t = t.join(F.broadcast(file_starts(spark, out)), "file_name")  # one row per file
    return t.select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, out: str, low: int, high: int) -> DataFrame:
    """Rows of doc_id low..high: files, row groups and pages outside are skipped by their indexes."""
    return spark.read.parquet(out).filter(F.col("doc_id").between(low, high)).select("doc_id", "n_tokens", "ids")


def id_digests(tokens: DataFrame) -> DataFrame:
    """The rows of ``read_tokens`` with the crc32 of their ids (little-endian 32-bit)."""

    def rows(batches):
        for b in batches:
            lists = b.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            at = at - at[0]
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_path(spark: SparkSession) -> str:
    """A new folder in the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
