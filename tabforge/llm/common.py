"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import ensure_checkpoint_dir

#: ASCII white space, and the words between it, as regular-expression classes.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the session's checkpoint folder and read it back: the
    lineage is cut and the rows outlive any executor (the folder is shared)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables. Only for tables whose every reader has itself been staged since, so
    that no later task, first run or repeated, reads them."""
    for df in staged:
        jvm, path = df.sparkSession._jvm, df._staged_path
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def broadcast_if_small(staged: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a staged table of narrow rows, if its row count (Parquet metadata)
    is within ``max_rows``; otherwise the join shuffles."""
    return F.broadcast(staged) if staged.count() <= max_rows else staged


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column starts with, for columns that are added for a while."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def let(value, body):
    """``body(value)`` with ``value`` computed once per row (bound as a lambda variable)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_bytes(batches, column: int, most: int = 4 << 20):
    """Arrow batches cut so that the texts (or bytes) of ``column`` are at most ``most`` bytes a piece,
    one row at least: what a task makes of a piece then takes bounded memory, and no row is lost."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, lo, before = np.cumsum(lengths, dtype=np.int64), 0, 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(lo, hi - lo)
            lo, before = hi, int(ends[hi - 1])


def split_words(text):
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text column (empty: no words)."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def running_total(df: DataFrame, order: list[str], size: str, label: str, partitions: int) -> DataFrame:
    """Stage ``df`` with ``start`` = sum of ``size`` over all rows before it in ``order``.

    ``order`` must be unique per row. Rows are range-partitioned on it (so equal leading keys
    split too), each partition adds up its own rows as a stream, and only one total per
    partition reaches the driver."""
    import pyarrow as pa

    schema = df.schema

    def local(batches):
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = b.column(schema.names.index(size)).to_numpy(zero_copy_only=False).astype("int64")
            ends = sizes.cumsum() + at
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(ends - sizes, pa.int64()), pa.array([pid] * len(sizes), pa.int32())],
                [*schema.names, "local_start", "pid"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    part = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    out = stage(part.mapInArrow(local, f"{ddl}, local_start long, pid int"), label)
    totals = {r["pid"]: r["s"] for r in out.groupBy("pid").agg(F.sum(size).alias("s")).collect()}
    offsets, at = [], 0
    for pid in sorted(totals):
        offsets.append((pid, at))
        at += int(totals[pid])
    spark = df.sparkSession
    small = F.broadcast(spark.createDataFrame(offsets, "pid int, pid_start long"))  # one row per partition
    return out.join(small, "pid").withColumn("start", F.col("pid_start") + F.col("local_start")).drop("pid", "pid_start", "local_start")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
