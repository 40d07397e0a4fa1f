"""Derived inputs built from the given tables, identical on Spark and in SQL.

Each Spark builder has a SQL twin (a CTE body) so a query and its oracle start from
the same rows. Nothing here is hand-made: all rows come from the parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.scalar import hash_bucket
from tabforge.operators.folds import assign_stratified_folds

K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- binary task: labelled documents are train, the rest are test ---------------


def train_docs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id")


SQL_TRAIN_DOCS = (
    "select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "from documents d join labels l on d.doc_id = l.doc_id"
)


def test_docs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left_anti")


SQL_TEST_DOCS = (
    "select d.doc_id, d.lang, d.source, d.n_chars from documents d "
    "where not exists (select 1 from labels l where l.doc_id = d.doc_id)"
)


def train_docs_folded(spark, d) -> DataFrame:
    return assign_stratified_folds(train_docs(spark, d), K, "doc_id", "quality")


SQL_TRAIN_DOCS_FOLDED = (
    f"select *, cast((row_number() over (partition by quality order by md5(cast(doc_id as varchar)), doc_id) - 1) % {K} as int) as fold "
    f"from ({SQL_TRAIN_DOCS})"
)


def sql_hash8(expr: str, salt: str = "") -> str:
    """DuckDB twin of ``hash_bucket``."""
    s = f"cast({expr} as varchar)" if not salt else f"('{salt}' || cast({expr} as varchar))"
    return f"('0x' || substr(md5({s}), 1, 8))::bigint"


# ---- pseudo scores: deterministic per (salt, id), equal in both engines ----------


def scores(spark, d, salt: str = "p") -> DataFrame:
    """(doc_id, y, p): labelled docs with a md5-derived score in [0, 1)."""
    return train_docs(spark, d).select(
        "doc_id", F.col("quality").alias("y"), (hash_bucket("doc_id", salt) / F.lit(4294967296.0)).alias("p")
    )


def sql_scores(salt: str = "p") -> str:
    return f"select doc_id, quality as y, {sql_hash8('doc_id', salt)} / 4294967296.0 as p from ({SQL_TRAIN_DOCS})"


# ---- line measures with real nulls ------------------------------------------------


def line_measures(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )


SQL_LINE_MEASURES = (
    "select l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0.0) as l_discount, "
    "l_tax, l_returnflag, l_linestatus from lineitem"
)


# ---- vote tables: three rule-based predictions over documents ---------------------


def vote_tables(spark, d) -> list[tuple[str, DataFrame, float]]:
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels").select("doc_id")
    a = docs.select("doc_id", F.when(F.col("n_chars") > 2000, "true").otherwise("false").alias("prediction"))
    b = docs.select("doc_id", F.when(F.col("lang") == "en", "1").otherwise("0").alias("prediction"))
    c = docs.join(lab, "doc_id", "left_semi").select(
        "doc_id",
        F.when(F.substring_index("source", "src", -1).cast("int") % 2 == 0, "True").otherwise("False").alias("prediction"),
    )
    return [("a", a, 2.0), ("b", b, 1.5), ("c", c, 1.0)]


SQL_VOTES = {
    "a": "select doc_id, case when n_chars > 2000 then 'true' else 'false' end as prediction from documents",
    "b": "select doc_id, case when lang = 'en' then '1' else '0' end as prediction from documents",
    "c": (
        "select doc_id, case when cast(split_part(source, 'src', 2) as int) % 2 = 0 then 'True' else 'False' end as prediction "
        "from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)"
    ),
}
VOTE_WEIGHTS = {"a": 2.0, "b": 1.5, "c": 1.0}
