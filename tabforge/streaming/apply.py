"""Apply fitted tables to a stream.

Every fitted table here (target-encoding means, ordinal codes, medians, bin edges,
group sizes) is a static DataFrame or a literal, so the *apply* side of an encoder is
a stream-static join or a projection: the same functions work on a streaming
DataFrame. The sink is a file sink under the session's checkpoint folder with an
``availableNow`` trigger (incremental, restartable from its checkpoint), not the
driver-memory sink.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabforge.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, directory: str, like: DataFrame, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files of ``directory`` as a stream with the schema of ``like``; with ``glob`` those of its
    entries of matching names, each a file or a folder of files (a table that many tasks wrote). All
    files that are there make one micro-batch unless ``max_files`` bounds it."""
    r = spark.readStream.schema(like.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if not glob:
        return r.parquet(directory)
    # a plain name as a pattern too: a path without one has to be a folder, and a filter on file
    # names would leave out the files of a folder
    pattern = glob if any(c in glob for c in "*?[{") else f"{glob[:-1]}[{glob[-1]}]"
    return r.parquet(f"{directory.rstrip('/')}/{pattern}")


def run_to_table(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Drain a streaming DataFrame into parquet under the checkpoint root and return
    the written rows as a batch DataFrame."""
    spark = stream.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    tag = name or "stream"
    base = f"{root}/{tag}-{uuid.uuid4().hex[:12]}"
    q = (
        stream.writeStream.format("parquet")
        .option("path", base + "/data")
        .option("checkpointLocation", base + "/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(base + "/data")
