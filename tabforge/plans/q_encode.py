"""Queries for encoding/imputation (E1-E9), category statistics (A1, A2) and the
fitted lookup (J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import encode as E
from tabforge.plans import fixtures as X
from tabforge.plans.catalog import register

K = X.K
M = 30.0  # written out: the SQL is not built from the operator's constant

_SQL_TE_BASE = f"""
with f as ({X.SQL_TRAIN_DOCS_FOLDED}),
g as (select avg(quality::double) as gm from f),
s as (select source, fold, sum(quality::double) as s, count(*) as n from f group by source, fold),
tot as (select source, sum(s) as ts, sum(n) as tn from s group by source)
"""


@register(
    "target_encode_oof",
    "E5 M2 A1",
    _SQL_TE_BASE
    + f"""select f.doc_id, f.fold, round((tot.ts - s.s + {M} * g.gm) / (tot.tn - s.n + {M}), 9) as source_te
from f join s on f.source = s.source and f.fold = s.fold join tot on f.source = tot.source cross join g""",
)
def q_target_encode_oof(spark, d):
    tr = X.train_docs_folded(spark, d)
    te = E.fit_target_encoding(tr, ["source"], "quality", "fold", K)
    out = E.apply_target_encoding_oof(tr, te, "fold", suffix="_te")
    return out.select("doc_id", "fold", F.round("source_te", 9).alias("source_te"))


@register(
    "target_encode_apply",
    "E6",
    _SQL_TE_BASE
    + f""", folds as (select source, ts, tn, unnest(range({K})) as fold from tot),
per as (select folds.source, (folds.ts - coalesce(s.s, 0) + {M} * g.gm) / (folds.tn - coalesce(s.n, 0) + {M}) as enc
        from folds left join s on folds.source = s.source and folds.fold = s.fold cross join g),
tab as (select source, avg(enc) as enc from per group by source)
select t.doc_id, round(coalesce(tab.enc, g.gm), 9) as source_te from ({X.SQL_TEST_DOCS}) t left join tab on t.source = tab.source cross join g""",
)
def q_target_encode_apply(spark, d):
    tr = X.train_docs_folded(spark, d)
    te = E.fit_target_encoding(tr, ["source"], "quality", "fold", K)
    out = E.apply_target_encoding_test(X.test_docs(spark, d), te, suffix="_te")
    return out.select("doc_id", F.round("source_te", 9).alias("source_te"))


@register(
    "category_target_stats",
    "A1",
    f"select source as category, fold, sum(quality::double) as y_sum, count(*) as n from ({X.SQL_TRAIN_DOCS_FOLDED}) group by 1, 2",
)
def q_category_target_stats(spark, d):
    return E.category_target_stats(X.train_docs_folded(spark, d), "source", "quality", "fold")


@register(
    "smoothed_mean",
    "A2",
    f"""with t as ({X.SQL_TRAIN_DOCS}), g as (select avg(quality::double) as gm from t)
select lang as category, count(*) as n, round((sum(quality::double) + {M} * gm) / (count(*) + {M}), 9) as smoothed from t cross join g group by lang, gm""",
)
def q_smoothed_mean(spark, d):
    r = E.smoothed_mean(X.train_docs(spark, d), "lang", "quality")
    return r.select("category", "n", F.round("smoothed", 9).alias("smoothed"))


_SPLIT_LM = f"select *, {X.sql_hash8('l_orderkey')} % 5 as fold from ({X.SQL_LINE_MEASURES})"


def _split_lm(spark, d):
    from tabforge.operators.folds import assign_folds

    return assign_folds(X.line_measures(spark, d), 5, "l_orderkey")


@register(
    "impute_median",
    "E1",
    f"""with b as ({_SPLIT_LM}), m as (select median(l_discount) as md, median(l_tax) as mt from b where fold <> 0)
select l_orderkey, l_linenumber, coalesce(l_discount, md) as l_discount, coalesce(l_tax, mt) as l_tax from b cross join m""",
)
def q_impute_median(spark, d):
    b = _split_lm(spark, d)
    med = E.fit_medians(b.where("fold <> 0"), ["l_discount", "l_tax"])
    return E.apply_impute_median(b, med).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@register(
    "impute_constant",
    "E2 E7",
    """select d.doc_id, coalesce(cast(l.quality as varchar), '__NA__') as quality, coalesce(cast(l.toxic as varchar), '__NA__') as toxic
from documents d left join labels l on d.doc_id = l.doc_id""",
)
def q_impute_constant(spark, d):
    df = X.table(spark, d, "documents").select("doc_id").join(X.table(spark, d, "labels"), "doc_id", "left")
    return E.impute_constant(df, ["quality", "toxic"])


@register(
    "ordinal_encode",
    "E3",
    f"""with b as (select o_orderkey, o_orderpriority, cast(o_custkey as varchar) as cust, {X.sql_hash8('o_orderkey')} % 5 as fold from orders),
c1 as (select v, cast(dense_rank() over (order by v) - 1 as int) as code from (select distinct o_orderpriority as v from b where fold <> 0)),
c2 as (select v, cast(dense_rank() over (order by v) - 1 as int) as code from (select distinct cust as v from b where fold <> 0))
select b.o_orderkey, coalesce(c1.code, -1) as o_orderpriority, coalesce(c2.code, -1) as cust
from b left join c1 on b.o_orderpriority = c1.v left join c2 on b.cust = c2.v""",
)
def q_ordinal_encode(spark, d):
    from tabforge.operators.folds import assign_folds

    b = assign_folds(X.table(spark, d, "orders"), 5, "o_orderkey").select(
        "o_orderkey", "o_orderpriority", F.col("o_custkey").cast("string").alias("cust"), "fold"
    )
    codes = E.fit_ordinal(b.where("fold <> 0"), ["o_orderpriority", "cust"])
    return E.apply_ordinal(b, codes, ["o_orderpriority", "cust"]).select("o_orderkey", "o_orderpriority", "cust")


@register(
    "standard_scale",
    "E4",
    f"""with b as ({_SPLIT_LM}), f as (select avg(l_quantity) as m1, stddev_pop(l_quantity) as s1, avg(l_tax) as m2, stddev_pop(l_tax) as s2 from b where fold <> 0)
select l_orderkey, l_linenumber, round((l_quantity - m1) / case when s1 = 0 then 1 else s1 end, 6) as l_quantity_z,
  round((l_tax - m2) / case when s2 = 0 then 1 else s2 end, 6) as l_tax_z from b cross join f""",
)
def q_standard_scale(spark, d):
    b = _split_lm(spark, d)
    fit = E.fit_standard_scale(b.where("fold <> 0"), ["l_quantity", "l_tax"])
    out = E.apply_standard_scale(b, fit, suffix="_z")
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 6).alias("l_quantity_z"), F.round("l_tax_z", 6).alias("l_tax_z"))


@register(
    "cast_categoricals",
    "E7",
    "select o_orderkey, o_totalprice, o_orderstatus, cast(o_orderstatus = 'F' as varchar) as is_final from orders",
)
def q_cast_categoricals(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_orderstatus") == "F").alias("is_final"))
    return E.cast_categoricals(o, ["o_orderstatus", "is_final"])


@register(
    "assign_folds",
    "M1",
    f"select o_orderkey, cast({X.sql_hash8('o_orderkey')} % 5 as int) as fold from orders",
)
def q_assign_folds(spark, d):
    from tabforge.operators.folds import assign_folds

    return assign_folds(X.table(spark, d, "orders"), 5, "o_orderkey").select("o_orderkey", "fold")


@register(
    "assign_stratified_folds",
    "M2",
    """select o_orderkey, o_orderstatus, cast((row_number() over (partition by o_orderstatus order by md5(cast(o_orderkey as varchar)), o_orderkey) - 1) % 5 as int) as fold
from orders""",
)
def q_assign_stratified_folds(spark, d):
    from tabforge.operators.folds import assign_stratified_folds

    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return assign_stratified_folds(o, 5, "o_orderkey", "o_orderstatus")


@register(
    "fold_scatter_join",
    "J4",
    f"""with f as ({X.SQL_TRAIN_DOCS_FOLDED}),
s as (select lang, fold, sum(n_chars) as s, count(*) as n from f group by 1, 2),
tot as (select lang, sum(s) as ts, sum(n) as tn from s group by 1)
select f.doc_id, f.fold, round((tot.ts - s.s) / nullif(tot.tn - s.n, 0), 6) as lang_mean_oof
from f join s on f.lang = s.lang and f.fold = s.fold join tot on f.lang = tot.lang""",
)
def q_fold_scatter(spark, d):
    from tabforge.operators.folds import fold_scatter

    f = X.train_docs_folded(spark, d)
    s = f.groupBy("lang", "fold").agg(F.sum("n_chars").alias("s"), F.count(F.lit(1)).alias("n"))
    tot = s.groupBy("lang").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    # per (lang, fold) statistic fitted on the other folds, written back to the held-out rows
    per = s.join(tot, "lang").select("lang", "fold", (F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))).alias("lang_mean_oof"))
    out = fold_scatter(f, per, ["lang"])
    return out.select("doc_id", "fold", F.round("lang_mean_oof", 6).alias("lang_mean_oof"))


@register(
    "stream_target_encode",
    "E6 streaming",
    _SQL_TE_BASE
    + f""", folds as (select source, ts, tn, unnest(range({K})) as fold from tot),
per as (select folds.source, (folds.ts - coalesce(s.s, 0) + {M} * g.gm) / (folds.tn - coalesce(s.n, 0) + {M}) as enc
        from folds left join s on folds.source = s.source and folds.fold = s.fold cross join g),
tab as (select source, avg(enc) as enc from per group by source)
select t.doc_id, round(coalesce(tab.enc, g.gm), 9) as source_te from ({X.SQL_TEST_DOCS}) t left join tab on t.source = tab.source cross join g""",
)
def q_stream_target_encode(spark, d):
    """E6 on a stream: the test documents arrive as a parquet stream; the encoding
    fitted on the (static) labelled documents is applied by a stream-static join."""
    from tabforge.streaming.apply import read_stream, run_to_table

    tr = X.train_docs_folded(spark, d)
    te = E.fit_target_encoding(tr, ["source"], "quality", "fold", K)
    docs = X.table(spark, d, "documents")
    stream = read_stream(spark, d, docs, glob="documents.parquet").select("doc_id", "lang", "source", "n_chars")
    unlabelled = stream.join(X.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    out = E.apply_target_encoding_test(unlabelled, te, suffix="_te").select("doc_id", F.round("source_te", 9).alias("source_te"))
    return run_to_table(out, "stream_te")
