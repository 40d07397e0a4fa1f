"""Queries for the profiling aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabforge.operators import profile as P
from tabforge.operators.encode import fit_medians
from tabforge.plans import fixtures as X
from tabforge.plans.catalog import register

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@register(
    "profile_shape",
    "P1 S3",
    "\nunion all\n".join(
        f"select '{t}' as table_name, count(*) as n_rows, "
        f"(select count(*) from information_schema.columns where table_name = '{t}') as n_cols from {t}"
        for t in ALL_TABLES
    ),
)
def q_profile_shape(spark, d):
    parts = [P.profile_shape(X.table(spark, d, t)).select(F.lit(t).alias("table_name"), "n_rows", "n_cols") for t in ALL_TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


_TARGET_SQL = """select cast(o_orderpriority as varchar) as value, count(*) as n, count(*) / sum(count(*)) over () as share
from orders where o_orderpriority is not null group by 1"""


@register("profile_target", "P2", f"select value, n, round(share, 9) as share from ({_TARGET_SQL})")
def q_profile_target(spark, d):
    return P.profile_target(X.table(spark, d, "orders"), "o_orderpriority").withColumn("share", F.round("share", 9))


@register(
    "profile_imbalance",
    "P3",
    f"""select round(max(share), 9) as majority_share, cast(max(share) > 0.65 as int) as imbalanced from (
  select count(*) / sum(count(*)) over () as share from ({X.SQL_TRAIN_DOCS}) group by quality)""",
)
def q_profile_imbalance(spark, d):
    r = P.profile_imbalance(X.train_docs(spark, d), "quality")
    return r.select(F.round("majority_share", 9).alias("majority_share"), "imbalanced")


_NULL_SRC = f"""select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, m.l_discount
from documents d left join labels l on d.doc_id = l.doc_id
left join (select l_orderkey, min(l_discount) as l_discount from ({X.SQL_LINE_MEASURES}) group by 1) m on m.l_orderkey = d.doc_id"""


@register(
    "profile_nulls",
    "P4 W4",
    f"""select column, round(null_pct, 9) as null_pct from (
  unpivot (select {", ".join(f"avg(case when {c} is null then 1.0 else 0.0 end) * 100 as {c}" for c in ["doc_id", "lang", "n_chars", "quality", "toxic", "l_discount"])}
           from ({_NULL_SRC})) on columns(*) into name column value null_pct) where null_pct > 0""",
)
def q_profile_nulls(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = X.table(spark, d, "labels")
    m = X.line_measures(spark, d).groupBy("l_orderkey").agg(F.min("l_discount").alias("l_discount"))
    df = docs.join(lab, "doc_id", "left").join(m, docs.doc_id == m.l_orderkey, "left")
    r = P.profile_nulls(df, ["doc_id", "lang", "n_chars", "quality", "toxic", "l_discount"])
    return r.select("column", F.round("null_pct", 9).alias("null_pct"))


_NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_numeric():
    parts = []
    for c in _NUM_COLS:
        parts.append(
            f"""select '{c}' as column, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c}) as min, max({c}) as max,
  count(*) filter (where {c} is null) as n_null,
  round(case when count({c}) < 3 then null when stddev_pop({c}) = 0 then 0.0 else skewness({c}) end, 6) as skew
from ({X.SQL_LINE_MEASURES})"""
        )
    return "\nunion all\n".join(parts)


@register("profile_numeric", "P5 P6", _sql_numeric())
def q_profile_numeric(spark, d):
    r = P.profile_numeric(X.line_measures(spark, d), _NUM_COLS)
    return r.select(
        "column",
        F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"),
        "min",
        "max",
        "n_null",
        F.round("skew", 6).alias("skew"),
    )


_CAT_SRC = "select o_orderstatus, o_orderpriority, cast(o_custkey % 3 as varchar) as cust_mod from orders"


@register(
    "profile_categorical",
    "P7 W2",
    f"""with c as (select column, value, count(*) as n from
  (unpivot (select * from ({_CAT_SRC})) on o_orderstatus, o_orderpriority, cust_mod into name column value value)
  group by all),
pc as (select column, count(*) filter (where value is not null) as n_distinct, coalesce(sum(n) filter (where value is null), 0) as n_null from c group by column),
top as (select *, row_number() over (partition by column order by n desc, value) as rank from c where value is not null)
select top.column, top.value, top.n, top.rank, pc.n_distinct, cast(pc.n_null as bigint) as n_null from top join pc using (column) where rank <= 4""",
)
def q_profile_categorical(spark, d):
    o = X.table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.expr("cast(o_custkey % 3 as string)").alias("cust_mod"))
    r = P.profile_categorical(o, ["o_orderstatus", "o_orderpriority", "cust_mod"], 4)
    return r.select("column", "value", "n", "rank", "n_distinct", F.col("n_null").cast("long").alias("n_null"))


# ---- correlations: orders joined to customers, target = order status ---------------

_CORR_SRC = """select o.o_orderstatus, o.o_totalprice, c.c_acctbal, cast(c.c_nationkey as double) as c_nationkey,
  o.o_orderpriority, c.c_mktsegment,
  cast(dense_rank() over (order by lower(trim(o.o_orderstatus))) - 1 as int) as y_code
from orders o join customer c on o.o_custkey = c.c_custkey"""


def _corr_frame(spark, d):
    o = X.table(spark, d, "orders")
    c = X.table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey)


_SQL_CORR_NUM = " union all ".join(
    f"select '{c}' as feature, round(abs(corr({c}, y_code)), 9) as abs_r from ({_CORR_SRC})"
    for c in ["o_totalprice", "c_acctbal", "c_nationkey"]
)

_SQL_CORR_HOT = f"""with b as ({_CORR_SRC}),
l as (select y_code, column, value from (unpivot (select y_code, o_orderpriority, c_mktsegment from b)
      on o_orderpriority, c_mktsegment into name column value value)),
c as (select column, value, count(*) as n from l group by all),
top as (select column, value from (select *, row_number() over (partition by column order by n desc, value) as rk from c) where rk <= 2)
select top.column || '==' || top.value as feature,
  round(abs(corr(case when l.value = top.value then 1.0 else 0.0 end, l.y_code)), 9) as abs_r
from top join l on l.column = top.column group by top.column, top.value"""


@register("profile_corr_numeric", "P8", _SQL_CORR_NUM)
def q_corr_numeric(spark, d):
    from tabforge.operators.infer import encode_target

    df = encode_target(_corr_frame(spark, d), "o_orderstatus", "y_code")
    return P.corr_numeric(df, ["o_totalprice", "c_acctbal", "c_nationkey"], "y_code").select("feature", F.round("abs_r", 9).alias("abs_r"))


@register("profile_corr_onehot", "P9", _SQL_CORR_HOT)
def q_corr_onehot(spark, d):
    from tabforge.operators.infer import encode_target

    df = encode_target(_corr_frame(spark, d), "o_orderstatus", "y_code")
    return P.corr_onehot(df, ["o_orderpriority", "c_mktsegment"], "y_code", top=2, max_cols=8).select("feature", F.round("abs_r", 9).alias("abs_r"))


@register(
    "profile_corr_top",
    "P10 W4",
    f"""select feature, abs_r from ({_SQL_CORR_NUM} union all select feature, abs_r from ({_SQL_CORR_HOT}))
order by abs_r desc, feature limit 20""",
)
def q_corr_top(spark, d):
    df = _corr_frame(spark, d)
    corrs = P.target_correlations(df, "o_orderstatus", ["o_totalprice", "c_acctbal", "c_nationkey"], ["o_orderpriority", "c_mktsegment"])
    return P.corr_top(corrs.select("feature", F.round("abs_r", 9).alias("abs_r")), 20)


@register(
    "data_summary",
    "P11",
    f"""with b as (select *, cast(dense_rank() over (order by lower(trim(cast(quality as varchar)))) - 1 as int) as y_code from ({X.SQL_TRAIN_DOCS})),
ex as (select column, count(*) as n_distinct, string_agg(value, '|' order by value) filter (where rk <= 5) as examples from (
   select column, value, row_number() over (partition by column order by value) as rk from (
     select distinct column, value from (unpivot (select lang, source from b) on lang, source into name column value value))) group by column)
select 'n_chars' as column, 'bigint' as dtype, round(avg(case when n_chars is null then 1.0 else 0.0 end), 9) as missing_share,
  round(corr(n_chars, y_code), 9) as corr, min(n_chars)::double as min, median(n_chars)::double as median, max(n_chars)::double as max,
  null::bigint as n_distinct, null::varchar as examples from b
union all
select column, 'string', 0.0, null, null, null, null, n_distinct, examples from ex""",
)
def q_data_summary(spark, d):
    df = X.train_docs(spark, d)
    med = fit_medians(df, ["n_chars"])
    r = P.data_summary(df, "quality", ["n_chars", "lang", "source"], ["n_chars"], med)
    return r.select(
        "column",
        "dtype",
        F.round("missing_share", 9).alias("missing_share"),
        F.round("corr", 9).alias("corr"),
        "min",
        "median",
        "max",
        "n_distinct",
        "examples",
    )


@register(
    "zero_rates",
    "P12",
    f"""select column, round(zero_rate, 9) as zero_rate from (unpivot (select
  {", ".join(f"avg(case when {c} = 0 then 1.0 else 0.0 end) as {c}" for c in ["l_quantity", "l_discount", "l_tax"])}
  from lineitem) on columns(*) into name column value zero_rate)""",
)
def q_zero_rates(spark, d):
    r = P.zero_rates(X.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return r.select("column", F.round("zero_rate", 9).alias("zero_rate"))


@register(
    "conditional_mean",
    "P13",
    f"""select column, round(positive_mean, 9) as positive_mean from (unpivot (select
  {", ".join(f"avg({c}) filter (where {c} > 0) as {c}" for c in ["l_quantity", "l_discount", "l_tax"])}
  from lineitem) on columns(*) into name column value positive_mean)""",
)
def q_conditional_mean(spark, d):
    r = P.conditional_mean(X.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return r.select("column", F.round("positive_mean", 9).alias("positive_mean"))


@register(
    "group_size_stats",
    "P14",
    """select round(sum(n * n) / sum(n), 9) as mean_size, max(n) as max_size, round(sum(case when n = 1 then 1 else 0 end) / sum(n), 9) as solo_share
from (select conv_id, count(*) as n from conversations group by conv_id)""",
)
def q_group_size_stats(spark, d):
    r = P.group_size_stats(X.table(spark, d, "conversations"), "conv_id")
    return r.select(F.round("mean_size", 9).alias("mean_size"), "max_size", F.round("solo_share", 9).alias("solo_share"))


@register(
    "group_rate",
    "P15",
    """select round(avg(r), 9) as group_rate from (
  select avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) over (partition by l_orderkey) as r from lineitem)""",
)
def q_group_rate(spark, d):
    r = P.group_rate(X.table(spark, d, "lineitem"), "l_orderkey", (F.col("l_returnflag") == "R").cast("int"))
    return r.select(F.round("group_rate", 9).alias("group_rate"))


@register(
    "activity_stats",
    "P16",
    f"""select round(avg(case when t > 0 then 1.0 else 0.0 end), 9) as active_share, round(avg(t), 6) as total_mean, round(max(t), 6) as total_max
from (select coalesce(l_discount, 0) + coalesce(l_tax, 0) as t from ({X.SQL_LINE_MEASURES}))""",
)
def q_activity_stats(spark, d):
    r = P.activity_stats(X.line_measures(spark, d), ["l_discount", "l_tax"])
    return r.select(F.round("active_share", 9).alias("active_share"), F.round("total_mean", 6).alias("total_mean"), F.round("total_max", 6).alias("total_max"))


@register(
    "part_distribution",
    "P17",
    """select split_part(c_name, '#', 1) as first_part, count(*) as n, min(try_cast(split_part(c_name, '#', 2) as double)) as num_min,
  max(try_cast(split_part(c_name, '#', 2) as double)) as num_max from customer group by 1""",
)
def q_part_distribution(spark, d):
    return P.part_distribution(X.table(spark, d, "customer"), "c_name", "#")


@register(
    "inconsistency_rate",
    "P18",
    f"""select round(avg(case when l_discount > 0 and l_linestatus = 'F' then 1.0 else 0.0 end), 9) as inconsistency_rate
from ({X.SQL_LINE_MEASURES})""",
)
def q_inconsistency_rate(spark, d):
    df = X.line_measures(spark, d).withColumn("flag", (F.col("l_linestatus") == "F").cast("int"))
    r = P.inconsistency_rate(df, "l_discount", "flag")
    return r.select(F.round("inconsistency_rate", 9).alias("inconsistency_rate"))
