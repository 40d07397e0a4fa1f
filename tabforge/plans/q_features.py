"""Queries for the feature operators (F1-F23), lookups and group joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions import scalar as S
from tabforge.operators import features as FE
from tabforge.operators.encode import fit_medians, lookup_join
from tabforge.operators.folds import assign_folds
from tabforge.plans import fixtures as X
from tabforge.plans.catalog import register

LM = X.SQL_LINE_MEASURES


@register(
    "split_composite",
    "F1",
    """select p_partkey, coalesce(string_split(p_name, ' ')[1], '__NA__') as w0, string_split(p_name, ' ')[2] as w1,
  string_split(p_name, ' ')[3] as w2 from part""",
)
def q_split_composite(spark, d):
    p = X.table(spark, d, "part")
    return p.select("p_partkey", *S.split_composite("p_name", " ", ["w0", "w1", "w2"]))


@register(
    "to_number",
    "F2",
    "select c_custkey, try_cast(split_part(c_name, '#', 2) as double) as num, try_cast(c_mktsegment as double) as seg_num from customer",
)
def q_to_number(spark, d):
    c = X.table(spark, d, "customer")
    return c.select("c_custkey", S.to_number(S.split_part_or_null("c_name", "#", 1)).alias("num"), S.to_number("c_mktsegment").alias("seg_num"))


@register(
    "bin_equal_width",
    "F3",
    """with f as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select l_orderkey, l_linenumber, cast(greatest(0, ceil((l_extendedprice - lo) / (hi - lo) * 10) - 1) as int) as price_bin
from lineitem cross join f""",
)
def q_bin_equal_width(spark, d):
    li = X.table(spark, d, "lineitem")
    lo, hi = FE.fit_equal_width(li, "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", S.bin_equal_width("l_extendedprice", lo, hi, 10).cast("int").alias("price_bin"))


@register(
    "bin_edges",
    "F4",
    """select l_orderkey, l_linenumber, case when l_quantity > 0 and l_quantity <= 12 then 0 when l_quantity > 12 and l_quantity <= 18 then 1
  when l_quantity > 18 and l_quantity <= 35 then 2 when l_quantity > 35 and l_quantity <= 60 then 3
  when l_quantity > 60 and l_quantity <= 200 then 4 end as qty_bin from lineitem""",
)
def q_bin_edges(spark, d):
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.bin_edges("l_quantity").alias("qty_bin"))


_CONV_ID = "cast(conv_id as varchar) || '_' || cast(turn as varchar)"


@register(
    "group_key",
    "F5",
    f"""select {_CONV_ID} as pid, split_part({_CONV_ID}, '_', 1) as grp, try_cast(split_part({_CONV_ID}, '_', 1) as double) as grp_num
from conversations""",
)
def q_group_key(spark, d):
    c = X.table(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("pid"))
    txt, num = S.group_key("pid", "_")
    return c.select("pid", txt.alias("grp"), num.alias("grp_num"))


_MEAS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SQL_TOTAL = " + ".join(f"coalesce({c}, 0)" for c in _MEAS)


@register("row_total", "F6", f"select l_orderkey, l_linenumber, round({_SQL_TOTAL}, 6) as total from ({LM})")
def q_row_total(spark, d):
    return X.line_measures(spark, d).select("l_orderkey", "l_linenumber", F.round(S.row_total(_MEAS), 6).alias("total"))


@register(
    "any_flag",
    "F7",
    f"select l_orderkey, l_linenumber, cast(coalesce(l_discount, 0) + coalesce(l_tax, 0) > 0 as int) as any_spend from ({LM})",
)
def q_any_flag(spark, d):
    return X.line_measures(spark, d).select("l_orderkey", "l_linenumber", S.any_flag(S.row_total(["l_discount", "l_tax"])).alias("any_spend"))


@register(
    "log1p_cols",
    "F8",
    f"""select l_orderkey, l_linenumber, round(ln(1 + ({_SQL_TOTAL})), 6) as log_total,
  round(ln(1 + coalesce(l_quantity, 0)), 6) as log_l_quantity, round(ln(1 + coalesce(l_discount, 0)), 6) as log_l_discount from ({LM})""",
)
def q_log1p(spark, d):
    lm = X.line_measures(spark, d)
    return lm.select(
        "l_orderkey",
        "l_linenumber",
        F.round(S.log1p(S.row_total(_MEAS)), 6).alias("log_total"),
        F.round(S.log1p(F.coalesce("l_quantity", F.lit(0.0))), 6).alias("log_l_quantity"),
        F.round(S.log1p(F.coalesce("l_discount", F.lit(0.0))), 6).alias("log_l_discount"),
    )


@register(
    "per_capita",
    "F9",
    f"""select m.l_orderkey, m.l_linenumber, round(({_SQL_TOTAL}) / coalesce(nullif(g.n, 0), 1), 6) as total_per_line
from ({LM}) m join (select l_orderkey, count(*) as n from lineitem group by 1) g on m.l_orderkey = g.l_orderkey""",
)
def q_per_capita(spark, d):
    lm = FE.group_size_join(X.line_measures(spark, d), "l_orderkey", "n", None)
    return lm.select("l_orderkey", "l_linenumber", F.round(S.per_capita(S.row_total(_MEAS), F.col("n")), 6).alias("total_per_line"))


_FLAG_TXT = "case when o_orderstatus = 'F' then 'True' when o_orderstatus = 'O' then 'false' else 'maybe' end"


@register(
    "bool_to_int",
    "F10",
    f"""select o_orderkey, case when lower(trim(f)) = 'true' then 1 when lower(trim(f)) = 'false' then 0 else -1 end as flag_int
from (select o_orderkey, {_FLAG_TXT} as f from orders)""",
)
def q_bool_to_int(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", F.expr(_FLAG_TXT).alias("f"))
    return o.select("o_orderkey", S.bool_to_int("f").alias("flag_int"))


_YN_TXT = "case when o_orderstatus = 'F' then ' Yes' when o_orderstatus = 'O' then '0' else 'n/a' end"


@register(
    "boolish_to_int",
    "F11",
    f"""select o_orderkey, case lower(trim(f)) when 'true' then 1 when 'yes' then 1 when '1' then 1 when 'false' then 0
  when 'no' then 0 when '0' then 0 else -1 end as f from (select o_orderkey, {_YN_TXT} as f from orders)""",
)
def q_boolish_to_int(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", F.expr(_YN_TXT).alias("f"))
    return o.select("o_orderkey", S.boolish_to_int("f").alias("f"))


@register(
    "inconsistency_flag",
    "F12",
    f"""select l_orderkey, l_linenumber, cast(l_linestatus = 'F' and coalesce(l_discount, 0) + coalesce(l_tax, 0) > 0 as int) as flag
from ({LM})""",
)
def q_inconsistency_flag(spark, d):
    lm = X.line_measures(spark, d)
    return lm.select("l_orderkey", "l_linenumber", S.inconsistency_flag((F.col("l_linestatus") == "F").cast("int"), S.row_total(["l_discount", "l_tax"])).alias("flag"))


_MED = f"(select median(l_discount) as med from ({LM}))"


@register(
    "interact_numeric",
    "F13 E1",
    f"""select l_orderkey, l_linenumber, round(coalesce(l_discount, med) * cast(l_returnflag = 'R' as int), 9) as disc_x_r
from ({LM}) cross join {_MED}""",
)
def q_interact_numeric(spark, d):
    lm = X.line_measures(spark, d)
    med = fit_medians(lm, ["l_discount"])["l_discount"]
    return lm.select("l_orderkey", "l_linenumber", F.round(S.interact("l_discount", (F.col("l_returnflag") == "R").cast("int"), med), 9).alias("disc_x_r"))


@register(
    "interact_log",
    "F14",
    f"""select l_orderkey, l_linenumber, round(coalesce(l_discount, med) * ln(1 + coalesce(l_quantity, 0) + coalesce(l_tax, 0)), 6) as disc_x_logq
from ({LM}) cross join {_MED}""",
)
def q_interact_log(spark, d):
    lm = X.line_measures(spark, d)
    med = fit_medians(lm, ["l_discount"])["l_discount"]
    return lm.select("l_orderkey", "l_linenumber", F.round(S.interact_log("l_discount", S.row_total(["l_quantity", "l_tax"]), med), 6).alias("disc_x_logq"))


@register(
    "cross_categories",
    "F15",
    """select d.doc_id, coalesce(d.lang, '__NA__') || '_' || coalesce(cast(l.quality as varchar), '__NA__') as lang_x_quality
from documents d left join labels l on d.doc_id = l.doc_id""",
)
def q_cross_categories(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "lang").join(X.table(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", S.cross_categories("lang", "quality").alias("lang_x_quality"))


@register(
    "datetime_parts",
    "F16",
    """select event_id, cast(year(t) as int) as ts_s_year, cast(month(t) as int) as ts_s_month, cast(day(t) as int) as ts_s_day,
  cast(hour(t) as int) as ts_s_hour, cast(isodow(t) - 1 as int) as ts_s_weekday
from (select event_id, try_cast(cast(ts as varchar) as timestamp) as t from events)""",
)
def q_datetime_parts(spark, d):
    e = X.table(spark, d, "events").select("event_id", F.col("ts").cast("string").alias("ts_s"))
    return e.select("event_id", *S.datetime_parts("ts_s", "ts_s"))


@register(
    "missing_indicators",
    "F17",
    f"select l_orderkey, l_linenumber, cast(l_discount is null as int) as l_discount__miss from ({LM})",
)
def q_missing_indicators(spark, d):
    lm = X.line_measures(spark, d)
    cols = FE.fit_missing_indicators(lm, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return FE.apply_missing_indicators(lm, cols).select("l_orderkey", "l_linenumber", *[f"{c}__miss" for c in cols])


@register("drop_id_like", "F18 I4", "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def q_drop_id_like(spark, d):
    from tabforge.operators.infer import id_like_columns

    c = X.table(spark, d, "customer")
    flags = id_like_columns(c, ["c_name", "c_mktsegment"]).where("id_like = 1").collect()
    return FE.drop_id_like(c, [r["column"] for r in flags])


@register(
    "carry_columns",
    "F19",
    "select p_partkey, cast(len(p_name) as int) as name_len, p_brand, p_type, p_size, p_retailprice from part",
)
def q_carry_columns(spark, d):
    p = X.table(spark, d, "part")
    return FE.carry_columns(p, {"p_partkey": F.col("p_partkey"), "name_len": F.length("p_name")}, {"p_name"})


@register("last_token", "F20", "select p_partkey, string_split(trim(p_name), ' ')[-1] as last_word from part")
def q_last_token(spark, d):
    return X.table(spark, d, "part").select("p_partkey", S.last_token("p_name").alias("last_word"))


# ---- F21: generic features, train/test split by hashed order key -------------------

_GEN_SRC = f"""select o_orderkey, cast(o_orderkey as varchar) as o_ref, o_orderstatus, o_totalprice,
  cast(o_orderdate as varchar) as o_orderdate_s, cast(o_orderstatus = 'F' as varchar) as is_final, o_orderpriority,
  case when o_totalprice > 300000 then null else o_totalprice end as price_capped,
  cast({X.sql_hash8('o_orderkey')} % 5 as int) as fold from orders"""


def _gen_frame(spark, d):
    o = X.table(spark, d, "orders")
    o = o.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("o_ref"),
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("string").alias("o_orderdate_s"),
        F.expr("cast(o_orderstatus = 'F' as string)").alias("is_final"),
        "o_orderpriority",
        F.expr("case when o_totalprice > 300000 then null else o_totalprice end").alias("price_capped"),
    )
    return assign_folds(o, 5, "o_orderkey")


@register(
    "generic_features",
    "F21 F16 F11 F17 F18",
    f"""select o_orderkey, case when fold = 0 then 'test' else 'train' end as split, o_orderstatus, o_totalprice,
  cast(year(t) as int) as o_orderdate_s_year, cast(month(t) as int) as o_orderdate_s_month, cast(day(t) as int) as o_orderdate_s_day,
  cast(hour(t) as int) as o_orderdate_s_hour, cast(isodow(t) - 1 as int) as o_orderdate_s_weekday,
  case lower(trim(is_final)) when 'true' then 1 when 'false' then 0 else -1 end as is_final,
  o_orderpriority, price_capped, cast(price_capped is null as int) as price_capped__miss
from (select *, try_cast(o_orderdate_s as timestamp) as t from ({_GEN_SRC}))""",
)
def q_generic_features(spark, d):
    o = _gen_frame(spark, d)
    train, test = o.where("fold <> 0").drop("fold"), o.where("fold = 0").drop("fold")
    # decisions are fitted on the train features; the key rides along untouched
    plan = FE.fit_generic(train.drop("o_orderkey"))
    tr, te = FE.apply_generic(train, plan), FE.apply_generic(test, plan)
    return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))


# ---- F22: domain features on a passenger-like view of lineitem ---------------------

_DOM_SRC = f"""select cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) as pid,
  l_returnflag || '/' || cast(l_suppkey as varchar) || '/' || l_linestatus as cabin,
  l_extendedprice, nullif(l_discount, 0.0) as l_discount, l_tax,
  case when l_linestatus = 'F' then 'True' else 'False' end as cryo, l_quantity as age, l_returnflag as home, l_linestatus as dest
from lineitem"""

_DOM_SPEC = FE.DomainSpec(
    id_col="pid",
    composite_col="cabin",
    measure_cols=("l_extendedprice", "l_discount", "l_tax"),
    flag_col="cryo",
    numeric_col="age",
    cross_a="home",
    cross_b="dest",
)


def _dom_frame(spark, d):
    li = X.table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("pid"),
        F.concat_ws("/", "l_returnflag", F.col("l_suppkey").cast("string"), "l_linestatus").alias("cabin"),
        "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        "l_tax",
        F.expr("case when l_linestatus = 'F' then 'True' else 'False' end").alias("cryo"),
        F.col("l_quantity").alias("age"),
        F.col("l_returnflag").alias("home"),
        F.col("l_linestatus").alias("dest"),
    )


def _sql_domain():
    tot = "(coalesce(l_extendedprice, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0))"
    return f"""with b as (select *, cast({X.sql_hash8('pid')} % 5 as int) as fold from ({_DOM_SRC})),
tr as (select * from b where fold <> 0),
fit as (select min(try_cast(split_part(cabin, '/', 2) as double)) as lo, max(try_cast(split_part(cabin, '/', 2) as double)) as hi,
          median(age) as med from tr),
gs as (select split_part(pid, '_', 1) as g, count(*) as n from tr group by 1)
select b.pid,
  coalesce(nullif(split_part(cabin, '/', 1), ''), '__NA__') as Cabin_Deck,
  try_cast(split_part(cabin, '/', 2) as double) as Cabin_Num,
  case when try_cast(split_part(cabin, '/', 2) as double) is null or try_cast(split_part(cabin, '/', 2) as double) < lo
         or try_cast(split_part(cabin, '/', 2) as double) > hi then null
       else cast(greatest(0, ceil((try_cast(split_part(cabin, '/', 2) as double) - lo) / (hi - lo) * 10) - 1) as double) end as CabinNum_bin,
  coalesce(nullif(split_part(cabin, '/', 3), ''), '__NA__') as Cabin_Side,
  try_cast(split_part(pid, '_', 1) as double) as "Group",
  coalesce(gs.n, 1) as GroupSize, cast(coalesce(gs.n, 1) = 1 as int) as IsSolo,
  round({tot}, 6) as TotalSpend, cast({tot} > 0 as int) as AnySpend, round(ln(1 + {tot}), 6) as LogTotalSpend,
  round({tot} / coalesce(nullif(coalesce(gs.n, 1), 0), 1), 6) as SpendPerPerson,
  coalesce(l_extendedprice, 0) as l_extendedprice, round(ln(1 + coalesce(l_extendedprice, 0)), 6) as Logl_extendedprice,
  coalesce(l_discount, 0) as l_discount, round(ln(1 + coalesce(l_discount, 0)), 6) as Logl_discount,
  coalesce(l_tax, 0) as l_tax, round(ln(1 + coalesce(l_tax, 0)), 6) as Logl_tax,
  case when lower(trim(cryo)) = 'true' then 1 when lower(trim(cryo)) = 'false' then 0 else -1 end as cryo_int,
  cast(lower(trim(cryo)) = 'true' and {tot} > 0 as int) as CryoSpend_flag,
  cast(case when age > 0 and age <= 12 then 0 when age > 12 and age <= 18 then 1 when age > 18 and age <= 35 then 2
       when age > 35 and age <= 60 then 3 when age > 60 and age <= 200 then 4 end as double) as age_bin,
  round(coalesce(age, med) * cast(lower(trim(cryo)) = 'true' as int), 9) as age_x_Flag,
  round(coalesce(age, med) * ln(1 + {tot}), 6) as age_x_Spend,
  coalesce(nullif(split_part(cabin, '/', 1), ''), '__NA__') || '_' || coalesce(dest, '__NA__') as Deck_x_dest,
  coalesce(home, '__NA__') || '_' || coalesce(dest, '__NA__') as home_x_dest,
  cryo, age, home, dest, case when fold = 0 then 'test' else 'train' end as split
from b cross join fit left join gs on split_part(b.pid, '_', 1) = gs.g"""


_ROUND6 = {"TotalSpend", "SpendPerPerson", "LogTotalSpend", "Logl_extendedprice", "Logl_discount", "Logl_tax", "age_x_Spend"}
_ROUND9 = {"age_x_Flag"}


@register("domain_features", "F22 F1 F3-F15 F19 J2 J3", _sql_domain())
def q_domain_features(spark, d):
    b = assign_folds(_dom_frame(spark, d), 5, "pid")
    train = b.where("fold <> 0")
    fit = FE.fit_domain(train, _DOM_SPEC)
    out = FE.apply_domain(b.withColumn("_pid", F.col("pid")), _DOM_SPEC, fit)
    out = out.withColumn("pid", F.col("_pid")).drop("_pid")
    out = out.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train")).drop("fold")
    return out.select(
        *[F.round(c, 6).alias(c) if c in _ROUND6 else F.round(c, 9).alias(c) if c in _ROUND9 else F.col(c) for c in out.columns]
    )


# ---- F23: a user feature function run through the gate ------------------------------


def _user_fe(train, test):
    def add(df):
        return df.withColumn("words_est", F.col("n_chars") / 5.0).withColumn("is_en", (F.col("lang") == "en").cast("int"))

    return add(train), add(test).withColumn("only_in_test", F.lit(1))


@register(
    "apply_plugin",
    "F23 S6",
    f"""select doc_id, lang, source, n_chars, n_chars / 5.0 as words_est, cast(lang = 'en' as int) as is_en, 'train' as split from ({X.SQL_TRAIN_DOCS})
union all
select doc_id, lang, source, n_chars, n_chars / 5.0, cast(lang = 'en' as int), 'test' from ({X.SQL_TEST_DOCS})""",
)
def q_apply_plugin(spark, d):
    tr = X.train_docs(spark, d).select("doc_id", "lang", "source", "n_chars")
    te = X.test_docs(spark, d)
    a, b = FE.apply_plugin(_user_fe, tr, te)
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))


# ---- joins and group statistics -------------------------------------------------------


@register(
    "lookup_join",
    "J1",
    f"""with o as (select *, {X.sql_hash8('o_orderkey')} % 5 as fold from orders),
t as (select o_custkey, avg(o_totalprice) as m from o where fold <> 0 group by 1),
g as (select avg(o_totalprice) as gm from o where fold <> 0)
select o.o_orderkey, round(coalesce(t.m, g.gm), 6) as cust_mean from o left join t on o.o_custkey = t.o_custkey cross join g""",
)
def q_lookup_join(spark, d):
    o = assign_folds(X.table(spark, d, "orders"), 5, "o_orderkey")
    tr = o.where("fold <> 0")
    table = tr.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    gm = tr.agg(F.avg("o_totalprice")).first()[0]
    out = lookup_join(o, "o_custkey", table, "o_custkey", "m", "cust_mean", gm)
    return out.select("o_orderkey", F.round("cust_mean", 6).alias("cust_mean"))


@register(
    "group_size_join",
    "J2",
    """select l_orderkey, l_linenumber, n as group_size, cast(n = 1 as int) as is_solo
from lineitem join (select l_orderkey as k, count(*) as n from lineitem group by 1) on l_orderkey = k""",
)
def q_group_size_join(spark, d):
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return FE.group_size_join(li, "l_orderkey")


@register(
    "train_group_stats_apply",
    "J3",
    f"""with c as (select conv_id, turn, {X.sql_hash8(_CONV_ID)} % 5 as fold from conversations),
s as (select cast(conv_id as varchar) as g, count(*) as n from c where fold <> 0 group by 1)
select c.conv_id, c.turn, coalesce(s.n, 1) as group_size, cast(coalesce(s.n, 1) = 1 as int) as is_solo
from c left join s on cast(c.conv_id as varchar) = s.g where c.fold = 0""",
)
def q_train_group_stats_apply(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("pid"))
    c = assign_folds(c, 5, "pid")
    sizes = FE.group_size_table(c.where("fold <> 0"), "conv_id")
    return FE.apply_group_sizes(c.where("fold = 0"), sizes, "conv_id").select("conv_id", "turn", "group_size", "is_solo")


@register("group_count", "A3", "select cast(user_id as varchar) as group_key, count(*) as n from events group by 1")
def q_group_count(spark, d):
    g = FE.group_size_table(X.table(spark, d, "events"), "user_id")
    return g.select(F.col("_gk").alias("group_key"), F.col("_gs").alias("n"))


@register(
    "group_transform",
    "W1",
    """select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) as grp_count,
  round(avg(l_extendedprice) over (partition by l_orderkey), 6) as grp_mean from lineitem""",
)
def q_group_transform(spark, d):
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = FE.group_transform(li, "l_orderkey", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "grp_count", F.round("grp_mean", 6).alias("grp_mean"))
