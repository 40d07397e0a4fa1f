"""Session construction and the few physical-plan helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "tabforge", **conf) -> SparkSession:
    """A session tuned for the operators here: AQE on, UTC, no UI."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # local mode runs everything in the driver JVM; only applies to a new JVM
        "spark.driver.memory": "8g",
    }
    defaults.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in defaults.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local-mode session with no
    setting gets a fresh scratch folder (tests, laptop runs)."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="tabforge-ckpt-")
        os.makedirs(conf_dir, exist_ok=True)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read back. The lineage is cut, the
    rows outlive any executor, and the optimizer knows their size. ``plain`` files are neither
    compressed nor dictionary-encoded, so that this size is close to that of the rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    w = df.write
    if plain:
        w = w.option("compression", "none").option("parquet.enable.dictionary", "false")
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitted_table(small: DataFrame) -> DataFrame:
    """The small side of a join as a staged table without a hint. Spark broadcasts it where its
    bytes are below ``spark.sql.autoBroadcastJoinThreshold``; beyond that the join shuffles, and AQE
    splits skewed keys. No counting job runs and nothing stays persisted."""
    return staged(small, "fitted", plain=True)


def ranked(distinct: DataFrame, by: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``distinct`` with ``out`` = 0-based rank of ``value`` among the rows of equal ``by`` (each
    (by, value) once). Rows are range-partitioned on (by, value) and staged, so a partition is a
    slice of the order. Counts per slice (at most one row per slice and ``by``) give offsets; the
    window runs inside a slice, so no column is ranked in one task."""
    n = partitions or int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = staged(distinct.repartitionByRange(n, *by, value).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = sliced.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = sliced.withColumn("_r", F.row_number().over(Window.partitionBy("_p", *by).orderBy(value)))
    joined = local.join(F.broadcast(offsets), ["_p", *by])  # bounded by the number of slices
    return joined.withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("int")).select(*distinct.columns, out)
