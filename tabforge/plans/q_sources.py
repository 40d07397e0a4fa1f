"""Queries for scans, sinks and column roles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabforge.plans import fixtures as X
from tabforge.plans.catalog import register
from tabforge.roles import align_columns, project_roles, resolve_roles
from tabforge.sources import io


@register("read_table", "S1", "select * from customer")
def q_read_table(spark, d):
    return io.read_table(spark, f"{d}/customer.parquet")


@register("find_tables", "S2", "select * from supplier")
def q_find_tables(spark, d):
    df = io.find_tables(spark, d, "supplier.parquet")
    return df


@register("preview", "S3 W4", "select * from part order by p_partkey limit 5")
def q_preview(spark, d):
    return io.preview(X.table(spark, d, "part"), "p_partkey", 5)


@register(
    "describe_schema",
    "S3",
    """select cast(ordinal_position - 1 as int) as position, column_name as column,
  case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string'
  when 'TIMESTAMP' then 'timestamp_ntz' else lower(data_type) end as dtype
from information_schema.columns where table_name = 'orders'""",
)
def q_describe_schema(spark, d):
    return io.describe_schema(X.table(spark, d, "orders"))


def _scratch(spark) -> str:
    """A fresh folder under the session's checkpoint root (shared on a cluster)."""
    from tabforge.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/predictions-{uuid.uuid4().hex}"


@register(
    "write_predictions",
    "S4 S1",
    "select doc_id, case when n_chars > 2000 then 'true' else 'false' end as prediction from documents",
)
def q_write_predictions(spark, d):
    pred = X.vote_tables(spark, d)[0][1]
    path = _scratch(spark) + "/out"
    io.write_predictions(pred, path, "doc_id", "prediction", "csv")
    back = io.read_table(spark, path, "csv")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("prediction").cast("string")).alias("prediction"))


@register("project_roles", "S5", "select lang, source, n_chars, toxic from documents d join labels l on d.doc_id = l.doc_id")
def q_project_roles(spark, d):
    train = X.train_docs(spark, d).select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
    template = train.select("doc_id", "quality")  # template: id, target
    roles = resolve_roles(train, template)
    return project_roles(train, roles)


@register(
    "align_columns",
    "S6",
    f"""select lang, source, n_chars, 'train' as split from ({X.SQL_TRAIN_DOCS})
union all select lang, source, n_chars, 'test' from ({X.SQL_TEST_DOCS})""",
)
def q_align_columns(spark, d):
    tr = X.train_docs(spark, d).select("lang", "quality", "source", "n_chars")
    te = X.test_docs(spark, d).select("doc_id", "n_chars", "source", "lang")
    a, b = align_columns(tr, te)
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))
