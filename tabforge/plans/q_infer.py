"""Queries for schema and task inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabforge.operators import infer as I
from tabforge.plans import fixtures as X
from tabforge.plans.catalog import register

# (name, table, expression as Spark SQL == DuckDB SQL)
_TARGETS = [
    ("labels.quality", "labels", "quality"),
    ("labels.toxic", "labels", "toxic"),
    ("orders.o_orderpriority", "orders", "o_orderpriority"),
    ("orders.o_orderstatus", "orders", "o_orderstatus"),
    ("orders.o_totalprice", "orders", "o_totalprice"),
    ("orders.is_final", "orders", "cast(o_orderstatus = 'F' as string)"),
    ("customer.c_mktsegment", "customer", "c_mktsegment"),
    ("embeddings.label", "embeddings", "label"),
    ("lineitem.l_returnflag", "lineitem", "l_returnflag"),
]


def _sql_detect(name, tbl, expr):
    e = expr.replace("as string", "as varchar")
    nd = "(count(distinct v) + max(case when v is null then 1 else 0 end))"
    return f"""select '{name}' as target,
  case when sum(case when v is null or v not in ('true', 'false') then 1 else 0 end) = 0 then 'BINARY'
       when {nd} = 2 then 'BINARY' when {nd} <= 25 then 'MULTICLASS' else 'REGRESSION' end as task,
  cast({nd} as bigint) as n_distinct,
  round(avg(case when try_cast(cast(y as varchar) as double) is not null then 1.0 else 0.0 end), 9) as numeric_share
from (select {e} as y, lower(trim(cast({e} as varchar))) as v from {tbl})"""


@register("detect_task", "I1", "\nunion all\n".join(_sql_detect(*t) for t in _TARGETS))
def q_detect_task(spark, d):
    by_table: dict[str, dict] = {}
    for name, tbl, expr in _TARGETS:
        by_table.setdefault(tbl, {})[name] = F.expr(expr)
    parts = [I.detect_tasks(X.table(spark, d, tbl), targets) for tbl, targets in by_table.items()]  # a scan a table
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("numeric_share", F.round("numeric_share", 9))


@register(
    "encode_target",
    "I2 W3",
    """with lt as (select label, cast(dense_rank() over (order by label) - 1 as int) as y_code
              from (select distinct lower(trim(o_orderpriority)) as label from orders))
select o.o_orderkey, lt.y_code from orders o join lt on lower(trim(o.o_orderpriority)) = lt.label""",
)
def q_encode_target(spark, d):
    o = X.table(spark, d, "orders")
    return I.encode_target(o, "o_orderpriority", "y_code").select("o_orderkey", "y_code")


@register(
    "rank_labels",
    "W3",
    """select label, min(o_orderpriority) as original, cast(dense_rank() over (order by label) - 1 as int) as code
from (select lower(trim(o_orderpriority)) as label, o_orderpriority from orders) group by label""",
)
def q_rank_labels(spark, d):
    return I.label_table(X.table(spark, d, "orders"), "o_orderpriority")


@register(
    "decode_predictions",
    "I3",
    """with lt as (select cast(dense_rank() over (order by label) - 1 as int) as code, original
              from (select lower(trim(c_mktsegment)) as label, min(c_mktsegment) as original from customer group by 1))
select c.c_custkey, coalesce(lt.original, cast(cast(c.c_custkey % 7 as int) as varchar)) as label
from customer c left join lt on cast(c.c_custkey % 7 as int) = lt.code""",
)
def q_decode_predictions(spark, d):
    c = X.table(spark, d, "customer")
    labels = I.label_table(c, "c_mktsegment")
    # predicted codes 0..6: 5 and 6 are not classes and stay as their code text
    pred = c.select("c_custkey", (F.col("c_custkey") % 7).cast("int").alias("code"))
    return I.decode_predictions(pred, "code", labels, "label").select("c_custkey", "label")


_ID_COLS = {"customer": ["c_name", "c_mktsegment"], "documents": ["text", "lang", "source"], "pages": ["url", "html"]}


def _sql_id_like():
    parts = []
    for t, cols in _ID_COLS.items():
        for c in cols:
            parts.append(
                f"select '{t}.{c}' as column, cast(count(distinct {c}) > 0.97 * count(*) and count(distinct {c}) > 50 as int) as id_like from {t}"
            )
    return "\nunion all\n".join(parts)


@register("id_like_columns", "I4", _sql_id_like())
def q_id_like(spark, d):
    parts = []
    for t, cols in _ID_COLS.items():
        r = I.id_like_columns(X.table(spark, d, t), cols)
        parts.append(r.select(F.concat(F.lit(t + "."), "column").alias("column"), "id_like"))
    return reduce(lambda a, b: a.unionByName(b), parts)


_DT_SRC = """select cast(o_orderdate as varchar) as o_orderdate_s, o_orderpriority, o_orderstatus,
  cast(o_totalprice as varchar) as o_totalprice_s from orders"""


@register(
    "datetime_columns",
    "I5",
    f"""select column, round(parse_share, 9) as parse_share, cast(parse_share > 0.8 as int) as is_datetime from (
  select unnest(['o_orderdate_s', 'o_orderpriority', 'o_orderstatus']) as column,
         unnest([avg(case when try_cast(o_orderdate_s as timestamp) is not null then 1.0 else 0.0 end),
                 avg(case when try_cast(o_orderpriority as timestamp) is not null then 1.0 else 0.0 end),
                 avg(case when try_cast(o_orderstatus as timestamp) is not null then 1.0 else 0.0 end)]) as parse_share
  from ({_DT_SRC}))""",
)
def q_datetime_columns(spark, d):
    o = X.table(spark, d, "orders").select(
        F.col("o_orderdate").cast("string").alias("o_orderdate_s"), "o_orderpriority", "o_orderstatus"
    )
    r = I.datetime_columns(o, ["o_orderdate_s", "o_orderpriority", "o_orderstatus"])
    return r.select("column", F.round("parse_share", 9).alias("parse_share"), "is_datetime")


_BOOL_SRC = """select cast(o_orderstatus = 'F' as varchar) as is_final,
  case when o_orderstatus = 'F' then 'Yes' when o_orderstatus = 'O' then 'no' else '1' end as yes_no,
  o_orderstatus, cast(o_custkey % 2 as varchar) as parity from orders"""


def _sql_bool():
    cols = ["is_final", "yes_no", "o_orderstatus", "parity"]
    parts = []
    for c in cols:
        v = f"lower(trim({c}))"
        parts.append(
            f"""select '{c}' as column,
  cast(count({v}) > 0 and count(*) filter (where {v} is not null and {v} not in ('true', 'false')) = 0 as int) as is_bool,
  cast(count({v}) > 0 and count(*) filter (where {v} is not null and {v} not in ('true', 'false', 'yes', 'no', '1', '0')) = 0 as int) as is_boolish
from ({_BOOL_SRC})"""
        )
    return "\nunion all\n".join(parts)


@register("boolean_columns", "I6", _sql_bool())
def q_boolean_columns(spark, d):
    o = X.table(spark, d, "orders").select(
        F.expr("cast(o_orderstatus = 'F' as string)").alias("is_final"),
        F.expr("case when o_orderstatus = 'F' then 'Yes' when o_orderstatus = 'O' then 'no' else '1' end").alias("yes_no"),
        "o_orderstatus",
        F.expr("cast(o_custkey % 2 as string)").alias("parity"),
    )
    return I.boolean_columns(o, ["is_final", "yes_no", "o_orderstatus", "parity"])


@register(
    "high_cardinality_columns",
    "I7",
    """select column, count(distinct value) as n_distinct, cast(count(distinct value) > 5 as int) as high_card
from (unpivot (select c_name, c_mktsegment, cast(c_nationkey as varchar) as c_nationkey from customer)
      on c_name, c_mktsegment, c_nationkey into name column value value) group by column""",
)
def q_high_card(spark, d):
    c = X.table(spark, d, "customer")
    return I.high_cardinality_columns(c, ["c_name", "c_mktsegment", "c_nationkey"])


@register(
    "composite_columns",
    "I8",
    """select 'p_brand' as column, '#' as sep, min(p_brand) as example,
  cast(len(string_split(min(p_brand), '#')) as bigint) as n_parts, cast(max(len(string_split(p_brand, '#'))) as bigint) as max_parts from part
union all
select 'p_name', '#', min(p_name), cast(len(string_split(min(p_name), '#')) as bigint), cast(max(len(string_split(p_name, '#'))) as bigint) from part""",
)
def q_composite(spark, d):
    return I.composite_columns(X.table(spark, d, "part"), ["p_brand", "p_name"], "#")


@register(
    "feature_hints",
    "I9",
    """with a as (select min(c_name) as ex_name, min(c_mktsegment) as ex_seg,
   count(*) filter (where lower(trim(c_name)) not in ('true','false')) as nb_name,
   count(*) filter (where lower(trim(c_mktsegment)) not in ('true','false')) as nb_seg,
   count(*) filter (where c_acctbal = 0) as z_bal from customer)
select 'c_name' as column, 'split on ''#'' into ' || cast(len(string_split(ex_name, '#')) as varchar) || ' parts' as hint from a where instr(ex_name, '#') > 0
union all select 'c_name', 'last token' from a
union all select 'c_name', 'cast boolean' from a where nb_name = 0
union all select 'c_mktsegment', 'cast boolean' from a where nb_seg = 0
union all select 'c_acctbal', 'total, any, log1p' from a where z_bal > 0
union all select 'c_name', 'group prefix before # of ' || ex_name from a where instr(ex_name, '#') > 0""",
)
def q_feature_hints(spark, d):
    return I.feature_hints(X.table(spark, d, "customer"), ["c_name", "c_mktsegment"], ["c_acctbal"], "c_name")
