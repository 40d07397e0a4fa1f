"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """One table; parquet by default, CSV with a header row and inferred (or
    given) types, JSON lines."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith((".json", ".jsonl")) else "parquet")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("inferSchema", schema is None).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def find_tables(spark: SparkSession, root: str, name: str, fmt: str | None = None) -> DataFrame | None:
    """The table of that name anywhere below ``root``: a file, or a folder of Spark part
    files. Of several the first by (depth, path) is taken; None when there is none. Folders are
    listed through the Hadoop file system, so any store that Spark reads will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    level = [path] if fs.exists(path) else []
    while level:
        found, below = [], []
        for folder in level:
            for st in fs.listStatus(folder):
                if st.getPath().getName() == name:
                    found.append(st.getPath().toString())
                elif st.isDirectory() and not st.getPath().getName().startswith(("_", ".")):
                    below.append(st.getPath())
        if found:
            return read_table(spark, min(found), fmt or ("csv" if name.endswith(".csv") else None))
        level = below
    return None


def preview(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """S3: the first ``n`` rows by an id order (the limit is the feature)."""
    return df.orderBy(order_by).limit(n)


def describe_schema(df: DataFrame) -> DataFrame:
    """S3: (position, column, dtype), metadata only."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def write_predictions(df: DataFrame, path: str, id_col: str, target_col: str, fmt: str = "csv") -> None:
    """Write ``(id, target)`` with a header; partitioned output, no driver collect."""
    out = df.select(id_col, target_col).write.mode("overwrite")
    if fmt == "csv":
        out.option("header", True).csv(path)
    else:
        out.parquet(path)
