"""Registered queries over the reference operators, with the SQL that they must equal.

Every query runs over whole tables. Floats are rounded to six places on both
sides, as the order of addition differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions import kernels
from tallywell.functions.redaction import redact
from tallywell.operators import claims, experiment, groups, quality
from tallywell.operators.metrics import columns_read, compile_metric, parse_contract
from tallywell.plans import audit_queries, governance, store_queries
from tallywell.plans.semantic import Semantic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def _contract(metric: str, kind: str, time_column: str = "o_orderdate", **more):
    return parse_contract({"metric": metric, "type": kind, "grain": "day", "time_column": time_column} | more)


def _metric(name: str, table: str, contract, sql: str, contracts=None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compile_metric(_table(spark, sf_dir, table), contract, contracts)
        return out.select("dt", *[F.round(c, 6).alias(c) for c in out.columns if c != "dt"])

    _register(name, sql)(query)


PAID = {"field": "o_orderstatus", "op": "=", "value": "F"}
CONTRACTS = {c.metric: c for c in (
    _contract("paid_orders", "count", order_key="o_orderkey", filters=[PAID]),
    _contract("all_orders", "count", order_key="o_orderkey"),
    _contract("paid_rate", "ratio", numerator={"metric": "paid_orders"}, denominator={"metric": "all_orders"}),
)}

_DAY = "strftime({c}, '%Y-%m-%d')"
_RATE = """
select coalesce(n.dt, d.dt) as dt, round(n.value / nullif(d.value, 0), 6) as value
from (select strftime(o_orderdate, '%Y-%m-%d') as dt, count(distinct o_orderkey)::double as value from orders where o_orderstatus = 'F' group by 1) n
full outer join (select strftime(o_orderdate, '%Y-%m-%d') as dt, count(distinct o_orderkey)::double as value from orders group by 1) d on n.dt = d.dt
"""
_metric("metric_ratio_nested", "orders", CONTRACTS["paid_rate"], _RATE, CONTRACTS)
_metric("metric_count", "orders", _contract("n", "count"), "select strftime(o_orderdate, '%Y-%m-%d') as dt, count(*)::double as value from orders group by 1")
_metric(
    "metric_count_distinct", "lineitem",
    _contract("returns", "count", "l_shipdate", order_key="l_orderkey", filters=[{"field": "l_returnflag", "op": "=", "value": "R"}]),
    "select strftime(l_shipdate, '%Y-%m-%d') as dt, count(distinct l_orderkey)::double as value from lineitem where l_returnflag = 'R' group by 1")
_metric("metric_sum", "orders", _contract("total", "sum", numerator={"metric": "o_totalprice"}),
        "select strftime(o_orderdate, '%Y-%m-%d') as dt, round(sum(o_totalprice), 6) as value from orders group by 1")
_metric("metric_avg", "orders", _contract("mean", "avg", numerator={"metric": "o_totalprice"}),
        "select strftime(o_orderdate, '%Y-%m-%d') as dt, round(avg(o_totalprice), 6) as value from orders group by 1")
_metric(
    "metric_ratio_columns", "lineitem",
    _contract("discount_rate", "ratio", "l_shipdate", numerator={"metric": "l_discount"}, denominator={"metric": "l_quantity"}),
    "select strftime(l_shipdate, '%Y-%m-%d') as dt, round(case when sum(l_quantity) = 0 then null else sum(l_discount) / sum(l_quantity) end, 6) as value,"
    " round(sum(l_discount), 6) as numerator, round(sum(l_quantity), 6) as denominator from lineitem group by 1")

for _name, _rule, _where in (
    ("eq", PAID, "o_orderstatus = 'F'"),
    ("ne", {"field": "o_orderstatus", "op": "!=", "value": "F"}, "o_orderstatus <> 'F'"),
    ("lt", {"field": "o_totalprice", "op": "<", "value": 50000.0}, "o_totalprice < 50000.0::double"),
    ("le", {"field": "o_custkey", "op": "<=", "value": 100}, "o_custkey <= 100"),
    ("gt", {"field": "o_custkey", "op": ">", "value": 100}, "o_custkey > 100"),
    ("ge", {"field": "o_totalprice", "op": ">=", "value": 100000.0}, "o_totalprice >= 100000.0::double"),
    ("in", {"field": "o_orderpriority", "op": "IN", "value": ["1-URGENT", "2-HIGH"]}, "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    ("not_in", {"field": "o_orderstatus", "op": "NOT IN", "value": ["F", "O"]}, "o_orderstatus not in ('F', 'O')"),
    ("null", {"field": "o_orderstatus", "op": "IS NULL"}, "o_orderstatus is null"),
    ("not_null", {"field": "o_orderstatus", "op": "IS NOT NULL"}, "o_orderstatus is not null"),
    ("equals_null", {"field": "o_orderstatus", "op": "=", "value": None}, "o_orderstatus = null"),
):
    _metric(f"metric_filter_{_name}", "orders", _contract("kept", "count", filters=[_rule]),
            f"select strftime(o_orderdate, '%Y-%m-%d') as dt, count(*)::double as value from orders where {_where} group by 1")


@_register("metric_test_order_excluded", """
select strftime(o_orderdate, '%Y-%m-%d') as dt, count(*)::double as value
from (select *, case when o_orderstatus = 'P' then null else o_orderkey % 10 = 0 end as test_order from orders) where test_order = false group by 1""")
def metric_test_order_excluded(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 10 == 0)
    return compile_metric(_table(spark, sf_dir, "orders").withColumn("test_order", flag), _contract("real", "count"))


@_register("metric_by_dimension", """
select strftime(o_orderdate, '%Y-%m-%d') as dt, o_orderstatus, count(*)::double as value from orders group by 1, 2""")
def metric_by_dimension(spark, sf_dir):
    return compile_metric(_table(spark, sf_dir, "orders"), _contract("n", "count", queryable_dimensions=["o_orderstatus"]), by=("o_orderstatus",))


@_register("query_metric_limit", f"select * from ({_RATE}) order by dt limit 30")
def query_metric_limit(spark, sf_dir):
    semantic = Semantic()
    semantic.compile("commerce", _table(spark, sf_dir, "orders"), CONTRACTS["paid_rate"], CONTRACTS)
    return semantic.frame("commerce", "paid_rate", 30).select("dt", F.round("value", 6).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compile_metric(_table(spark, sf_dir, "orders"), CONTRACTS["paid_rate"], CONTRACTS)
    return out.orderBy(F.asc_nulls_last("dt"))


@_register("health_profile", """
select count(*) as row_count, count(*) filter (o_orderdate::varchar like '%/%') as slash_o_orderdate,
  count(*) filter (o_orderdate::varchar like '%-%') as dash_o_orderdate,
  count(*) filter (o_totalprice is null or trim(o_totalprice::varchar) = '') as blank_o_totalprice from orders""")
def health_profile(spark, sf_dir):
    return quality.health_profile(_table(spark, sf_dir, "orders"))


@_register("assert_not_null", "select count(*) filter (lang is null or trim(lang) = '') as blank_rows, count(*) filter (text is null or trim(text) = '') as blank_texts from documents")
def assert_not_null(spark, sf_dir):
    return _table(spark, sf_dir, "documents").agg(
        F.count_if(quality.is_blank(F.col("lang"))).alias("blank_rows"), F.count_if(quality.is_blank(F.col("text"))).alias("blank_texts"))


@_register("assert_enum", "select count(*) filter (lower(event_type::varchar) not in ('click', 'view')) as affected_rows from events")
def assert_enum(spark, sf_dir):
    a = quality.enum_values("event_type", ["Click", "view"])
    return _table(spark, sf_dir, "events").agg(a.aggregates["n"].alias("affected_rows"))


@_register("assert_unique", """
select count(*) as duplicate_keys, coalesce(sum(n), 0)::bigint as duplicate_rows from (select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1)""")
def assert_unique(spark, sf_dir):
    return quality.duplicates(_table(spark, sf_dir, "lineitem"), "l_orderkey")


@_register("assert_referential", """
select l_orderkey, l_linenumber from lineitem l left join (select * from orders where o_orderstatus = 'F') o on l.l_orderkey = o.o_orderkey where o.o_orderkey is null""")
def assert_referential(spark, sf_dir):
    parents = _table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return quality.orphans(_table(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey").select("l_orderkey", "l_linenumber")


@_register("assert_cross_source", """
select o_orderkey as key, round(o_totalprice, 6) as source_value, round(total, 6) as target_value
from orders join (select l_orderkey, sum(l_extendedprice) as total from lineitem group by 1) on o_orderkey = l_orderkey where abs(o_totalprice - total) > 0.01::double""")
def assert_cross_source(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"))
    out = quality.mismatches(_table(spark, sf_dir, "orders"), lines, "o_orderkey", "o_totalprice", "total", 0.01)
    return out.select("key", F.round("source_value", 6).alias("source_value"), F.round("target_value", 6).alias("target_value"))


_DAILY = "select strftime(o_orderdate, '%Y-%m-%d') as dt, count(*) as n from orders group by 1"


def _daily(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("n"))


@_register("row_count_band", f"""
select dt, n, round(mean, 6) as mean, coalesce(n between mean * 0.6::double and mean * 1.4::double, true) as passed
from (select *, avg(n) over (order by dt rows between 7 preceding and 1 preceding) as mean from ({_DAILY}))""")
def row_count_band(spark, sf_dir):
    return quality.row_count_bands(_daily(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@_register("trend_series", f"""
select dt, value, round((value - p) / nullif(abs(p), 0), 6) as change from (select dt, n::double as value, lag(n::double) over (order by dt) as p from ({_DAILY}))""")
def trend_series(spark, sf_dir):
    series = _daily(spark, sf_dir).select("dt", F.col("n").cast("double").alias("value"))
    return quality.trend_series(series).withColumn("change", F.round("change", 6))


@_register("k_anonymity_groups", "select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2 having count(*) < 10")
def k_anonymity_groups(spark, sf_dir):
    return groups.k_anonymity_groups(_table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 10)


def _arms(spark, sf_dir) -> DataFrame:
    """Customers by arm; converted means an order of status F."""
    paid = _table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey")).distinct()
    c = _table(spark, sf_dir, "customer").join(paid.withColumn("converted", F.lit("yes")), "c_custkey", "left")
    return c.withColumn("arm", experiment.assign(F.col("c_custkey"), "exp-1", {"a": 0.5, "b": 0.5}))


_BUCKET = "(('0x' || substr(sha256('exp-1:' || c_custkey::varchar), 1, 16))::ubigint % 1000)::int"
_ARMS = f"""(select c.*, case when {_BUCKET} < 500 then 'a' else 'b' end as arm, p.o_custkey is not null as converted
from customer c left join (select distinct o_custkey from orders where o_orderstatus = 'F') p on c.c_custkey = p.o_custkey)"""


@_register("ab_bucket_assign", f"select c_custkey, {_BUCKET} as bucket, case when {_BUCKET} < 300 then 'control' else 'treatment' end as arm from customer")
def ab_bucket_assign(spark, sf_dir):
    c = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        c, experiment.unit_bucket(c, "exp-1").alias("bucket"), experiment.assign(c, "exp-1", {"treatment": 0.7, "control": 0.3}).alias("arm"))


@_register("group_counts", f"""
select count(*) filter (arm = 'a' and converted) as s_a, count(*) filter (arm = 'a') as n_a,
  count(*) filter (arm = 'b' and converted) as s_b, count(*) filter (arm = 'b') as n_b from {_ARMS}""")
def group_counts(spark, sf_dir):
    return groups.group_counts(_arms(spark, sf_dir), "arm", "converted")


@_register("z_statistic", f"""
with c as (select count(*) filter (arm = 'a' and converted)::double as s_a, count(*) filter (arm = 'a')::double as n_a,
  count(*) filter (arm = 'b' and converted)::double as s_b, count(*) filter (arm = 'b')::double as n_b from {_ARMS})
select round(s_a / n_a - s_b / n_b, 6) as diff, round(coalesce((s_a / n_a - s_b / n_b) / nullif(sqrt((s_a + s_b) / (n_a + n_b) * (1 - (s_a + s_b) / (n_a + n_b)) * (1 / n_a + 1 / n_b)), 0), 0), 6) as z from c""")
def z_statistic(spark, sf_dir):
    c = groups.group_counts(_arms(spark, sf_dir), "arm", "converted")
    diff, z = groups.two_proportion_terms(*[F.col(x).cast("double") for x in ("s_a", "n_a", "s_b", "n_b")])
    return c.select(F.round(diff, 6).alias("diff"), F.round(z, 6).alias("z"))


@_register("srm_chi2", f"""
with c as (select arm, count(*) as observed from {_ARMS} group by 1), t as (select sum(observed)::double as total from c)
select arm, observed, round(total * 0.5::double, 6) as expected, round((observed - total * 0.5::double) * (observed - total * 0.5::double) / (total * 0.5::double), 6) as term from c, t""")
def srm_chi2(spark, sf_dir):
    out = experiment.srm_terms(_arms(spark, sf_dir), "arm", {"a": 0.5, "b": 0.5})
    return out.select("arm", "observed", F.round("expected", 6).alias("expected"), F.round("term", 6).alias("term"))


@_register("welch_sufficient", f"""
select arm as grp, count(c_acctbal) as n, round(avg(c_acctbal), 6) as mean, round(var_samp(c_acctbal), 4) as var, round(median(c_acctbal), 6) as median from {_ARMS} group by 1""")
def welch_sufficient(spark, sf_dir):
    arms = _arms(spark, sf_dir)
    m = groups.moments(arms, "arm", "c_acctbal").join(groups.medians(arms, "arm", "c_acctbal"), "grp")
    return m.select("grp", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"), F.round("median", 6).alias("median"))


@_register("mann_whitney_ranks", f"""
with r as (select arm as grp, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0::double as rank from {_ARMS})
select grp, count(*)::bigint as n, round(sum(rank), 6) as rank_sum from r group by 1""")
def mann_whitney_ranks(spark, sf_dir):
    out = groups.rank_sums(_arms(spark, sf_dir), "arm", "c_acctbal")
    return out.select("grp", F.col("n").cast("long").alias("n"), F.round(F.col("rank_sum").cast("double"), 6).alias("rank_sum"))


@_register("redact_customer", """
select c_custkey, left(c_name, 1) || repeat('*', greatest(length(c_name) - 1, 1)) as c_name, c_nationkey, c_acctbal,
  'tok_' || substr(sha256('s1:' || c_mktsegment), 1, 12) as c_mktsegment from customer""")
def redact_customer(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    policy = {"c_mktsegment": "restricted", "c_name": "confidential", "c_nationkey": "public"}
    return redact(df, policy, salt="s1")


@_register("claims_reconcile", """
with r as (select strftime(o_orderdate, '%Y-%m-%d') as dt, count(*)::double as value from orders group by 1),
c as (select dt as period, case when day(dt::date) = 13 then value + 1 else value end as value from r union all select 'never', 1.0::double)
select c.period, c.value, r.value as replayed, case when r.value is null then 'missing' when abs(c.value - r.value) >= 1e-9::double then 'differs' end as reason,
  case when r.value is not null and abs(c.value - r.value) < 1e-9::double then 'PASS' else 'FAIL' end as status from c left join r on c.period = r.dt""")
def claims_reconcile(spark, sf_dir):
    replay = compile_metric(_table(spark, sf_dir, "orders"), _contract("n", "count"))
    told = replay.select(F.col("dt").alias("period"), F.when(F.dayofmonth(F.col("dt").cast("date")) == 13, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    told = told.unionByName(spark.createDataFrame([("never", 1.0)], "period string, value double"))
    return claims.reconcile_claims(told, replay).select("period", "value", "replayed", "reason", "status")


@_register("narrative_numbers", """
with t as (select doc_id, unnest(regexp_extract_all(text, '-?\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?%?')) as token from documents)
select doc_id, token, round(case when token like '%\\%' escape '\\' then replace(replace(token, ',', ''), '%', '')::double / 100 else replace(token, ',', '')::double end, 9) as number
from t where token like '%.%' or token like '%\\%%' escape '\\'""")
def narrative_numbers(spark, sf_dir):
    t = claims.number_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return t.select("doc_id", "token", F.round("number", 9).alias("number"))


@_register("guardrails", """
with v as (select event_type as name, avg(case when event_id % 2 = 0 then value end) as baseline, avg(case when event_id % 2 = 1 then value end) as variant from events group by 1),
g(name, direction, threshold) as (values ('click', 'not_increase', 0.5::double), ('view', 'not_decrease', 0.1::double), ('nowhere', 'not_increase', 0.0::double))
select g.name, direction, threshold, round(variant - baseline, 6) as delta, case when variant is null or baseline is null then 'NO_DATA'
  when direction = 'not_increase' and variant - baseline > threshold then 'BROKEN' when direction = 'not_decrease' and variant - baseline < -threshold then 'BROKEN' else 'OK' end as status
from g left join v on g.name = v.name""")
def guardrails(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    values = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.avg(F.when(even, F.col("value"))).alias("baseline"), F.avg(F.when(~even, F.col("value"))).alias("variant"))
    rails = spark.createDataFrame([("click", "not_increase", 0.5), ("view", "not_decrease", 0.1), ("nowhere", "not_increase", 0.0)], "name string, direction string, threshold double")
    return experiment.guardrail_status(rails, values).withColumn("delta", F.round("delta", 6))


_KINDS = "case typeof({c}) when 'BIGINT' then 'integer' when 'INTEGER' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' else 'datetime' end"


def _schema_sql(table: str, prefix: str, columns: tuple[str, ...]) -> str:
    """One row for each column, its kind taken from the first row and its nulls from all."""
    return " union all ".join(
        f"select '{c}' as name, max({_KINDS.format(c=prefix + c)}) as type, count(*) > count({prefix}{c}) or '{c}' not like '%key' as nullable from {table}" for c in columns)


_CUSTOMER, _SUPPLIER = ("custkey", "name", "nationkey", "acctbal", "mktsegment"), ("suppkey", "name", "nationkey", "acctbal")


@_register("contract_diff", f"""
with o as ({_schema_sql("customer", "c_", _CUSTOMER)}), n as ({_schema_sql("supplier", "s_", _SUPPLIER)} union all {_schema_sql("region", "r_", ("regionkey",))})
select coalesce(o.name, n.name) as name, case when n.name is null then 'removed' when o.name is null then 'added' when o.type <> n.type then 'type_changed' else 'nullability_tightened' end as kind
from o full outer join n on o.name = n.name where o.name is null or n.name is null or o.type <> n.type or (o.nullable and not n.nullable)""")
def contract_diff(spark, sf_dir):
    """From the contract that customers keep to the one that suppliers and regions keep; keys without a null are required."""
    def observed(table: str, prefix: str, names: tuple[str, ...]) -> list[dict]:
        df = _table(spark, sf_dir, table)
        kinds = {"bigint": "integer", "int": "integer", "double": "number", "string": "string"}
        nulls = df.agg(*[F.count_if(F.col(prefix + c).isNull()).alias(c) for c in names]).first().asDict()
        types = dict(df.dtypes)
        return [{"name": c, "type": kinds.get(types[prefix + c], "datetime"), "nullable": nulls[c] > 0 or not c.endswith("key")} for c in names]

    old = observed("customer", "c_", _CUSTOMER)
    new = observed("supplier", "s_", _SUPPLIER) + observed("region", "r_", ("regionkey",))
    return governance.contract_changes(governance.contract_columns(spark, old), governance.contract_columns(spark, new))


def _shift_sql(value: str, table: str = "lineitem", group: str = "l_returnflag", one: str = "A", two: str = "R") -> str:
    """Weighted differences are counted in slots; only the slots of the middle are looked at one by one."""
    return f"""
with g as (select {group} as f, {value} as v, count(*)::double as w from {table} where {group} in ('{one}', '{two}') and {value} is not null group by 1, 2),
d as (select a.v - b.v as x, a.w * b.w as w from g a, g b where a.f = '{one}' and b.f = '{two}'),
h as (select floor(x / 16) as slot, sum(w) as w from d group by 1),
k as (select slot, sum(w) over (order by slot) as upto, sum(w) over () as n from h),
m as (select min(slot) filter (upto >= floor((n + 1) / 2)) as a, min(slot) filter (upto >= floor(n / 2) + 1) as b, max(n) as n from k),
e as (select x, sum(w) as w from d, m where floor(x / 16) in (m.a, m.b) group by 1),
c as (select x, sum(w) over (order by x) + (select coalesce(sum(w), 0) from h, m where slot < m.a) as upto from e)
select round((min(x) filter (upto >= floor((n + 1) / 2)) + min(x) filter (upto >= floor(n / 2) + 1)) / 2.0::double, 6) as shift from c, m"""


def _shift(spark, sf_dir, value):
    shift = groups.hodges_lehmann(_table(spark, sf_dir, "lineitem"), "l_returnflag", value, "A", "R")
    return spark.createDataFrame([(None if shift is None else round(shift, 6),)], "shift double")


@_register("hodges_lehmann", _shift_sql("l_quantity"))
def hodges_lehmann(spark, sf_dir):
    return _shift(spark, sf_dir, "l_quantity")


@_register("hodges_lehmann_whole", _shift_sql("l_extendedprice"))
def hodges_lehmann_whole(spark, sf_dir):
    """Of values so many that their differences are counted and not formed."""
    return _shift(spark, sf_dir, "l_extendedprice")


# -- tests with p-values: tails by Simpson's rule in SQL, as DuckDB has no erf --------

_Z = 1.959963984540054
_STEPS = 2000


def _simpson(height: str, upto: str) -> str:
    """SQL of the integral of ``height`` (of x) from 0 to ``upto``."""
    x = f"(i * ({upto}) / {_STEPS})"
    weight = f"case when i in (0, {_STEPS}) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(select sum({weight} * {height.format(x=x)}) * ({upto}) / {3 * _STEPS} from range(0, {_STEPS + 1}) steps(i))"


def _normal_p(z: str) -> str:
    return "greatest(0.0::double, 1 - 2 * " + _simpson("exp(-{x} * {x} / 2)", f"abs({z})") + " / sqrt(2 * pi()))"


def _t_p(t: str, df: str) -> str:
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    return "greatest(0.0::double, 1 - 2 * " + _simpson(f"pow(1 + {{x}} * {{x}} / {df}, -({df} + 1) / 2)", f"abs({t})") + f" * {scale})"


_COUNTS = f"""c as (select count(*) filter (arm = 'a' and converted)::double as s_a, count(*) filter (arm = 'a')::double as n_a,
  count(*) filter (arm = 'b' and converted)::double as s_b, count(*) filter (arm = 'b')::double as n_b from {_ARMS})"""


def _one_row(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def _counts(spark, sf_dir) -> tuple:
    return tuple(groups.group_counts(_arms(spark, sf_dir), "arm", "converted").first())


@_register("test_two_proportion", f"""
with {_COUNTS}, v as (select s_a / n_a as p, s_b / n_b as q, (s_a + s_b) / (n_a + n_b) as pool, n_a, n_b from c),
t as (select p - q as diff, coalesce((p - q) / nullif(sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b)), 0), 0) as z, {_Z} * sqrt(p * (1 - p) / n_a + q * (1 - q) / n_b) as wide from v)
select round(diff, 6) as effect, round(diff - wide, 6) as low, round(diff + wide, 6) as high, round(z, 6) as z, round({_normal_p("z")}, 6) as p_value from t""")
def test_two_proportion(spark, sf_dir):
    r = kernels.two_proportion(*_counts(spark, sf_dir))
    return _one_row(spark, effect=round(r["effect"]["value"], 6), low=round(r["effect"]["ci"][0], 6), high=round(r["effect"]["ci"][1], 6),
                    z=round(r["statistic"]["z"], 6), p_value=round(r["p_value"], 6))


@_register("test_welch", f"""
with g as (select arm, count(c_acctbal)::double as n, avg(c_acctbal) as m, var_samp(c_acctbal) as v from {_ARMS} group by 1),
w as (select a.m - b.m as diff, a.v / a.n as p, b.v / b.n as q, a.n as n, b.n as k from g a, g b where a.arm = 'a' and b.arm = 'b'),
t as (select diff, sqrt(p + q) as se, pow(p + q, 2) / (p * p / (n - 1) + q * q / (k - 1)) as df from w),
z as (select *, {_Z} as z from t),
e as (select *, z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df) as far from z)
select round(diff, 4) as effect, round(diff - far * se, 4) as low, round(diff + far * se, 4) as high, round(diff / se, 6) as t, round(df, 4) as df,
  round({_t_p("(diff / se)", "df")}, 6) as p_value from e""")
def test_welch(spark, sf_dir):
    m = {r["grp"]: r for r in groups.moments(_arms(spark, sf_dir), "arm", "c_acctbal").collect()}
    r = kernels.welch(*[m[g][k] for g in "ab" for k in ("n", "mean", "var")])
    return _one_row(spark, effect=round(r["effect"]["value"], 4), low=round(r["effect"]["ci"][0], 4), high=round(r["effect"]["ci"][1], 4),
                    t=round(r["statistic"]["t"], 6), df=round(r["statistic"]["df"], 4), p_value=round(r["p_value"], 6))


@_register("test_mann_whitney", f"""
with r as (select arm, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0::double as rank, count(*) over (partition by c_acctbal) as ties
  from {_ARMS} where c_acctbal is not null),
s as (select sum(rank) filter (arm = 'a') as ra, count(*) filter (arm = 'a')::double as n, count(*) filter (arm = 'b')::double as m, sum(ties * ties - 1)::double as tie from r),
u as (select ra - n * (n + 1) / 2 as u, n, m, n * m / 12 * (n + m + 1 - tie / ((n + m) * (n + m - 1))) as var from s),
z as (select *, greatest(0, greatest(u, n * m - u) - n * m / 2 - 0.5::double) / sqrt(var) as z from u)
select round(u, 4) as u, round(2 * u / (n * m) - 1, 6) as rank_biserial, round({_normal_p("z")}, 6) as p_value, round(shift, 4) as effect
from z, ({_shift_sql("c_acctbal", _ARMS, "arm", "a", "b")})""")
def test_mann_whitney(spark, sf_dir):
    k = {r["grp"]: r for r in groups.rank_sums(_arms(spark, sf_dir), "arm", "c_acctbal").collect()}
    n, m = int(k["a"]["n"]), int(k["b"]["n"])
    shift = groups.hodges_lehmann(_arms(spark, sf_dir), "arm", "c_acctbal", "a", "b")
    r = kernels.mann_whitney(float(k["a"]["rank_sum"]) - n * (n + 1) / 2, n, m, float(k["a"]["tie_sum"]), shift)
    return _one_row(spark, effect=round(r["effect"]["value"], 4), u=round(r["statistic"]["u"], 4), rank_biserial=round(r["statistic"]["rank_biserial"], 6), p_value=round(r["p_value"], 6))


@_register("test_fisher", f"""
with {_COUNTS}, k as (select c.*, unnest(range(greatest(0, s_a + s_b - n_b)::bigint, least(n_a, s_a + s_b)::bigint + 1))::double as k from c),
l as (select *, lgamma(n_a + 1) - lgamma(k + 1) - lgamma(n_a - k + 1) + lgamma(n_b + 1) - lgamma(s_a + s_b - k + 1) - lgamma(n_b - s_a - s_b + k + 1)
  - lgamma(n_a + n_b + 1) + lgamma(s_a + s_b + 1) + lgamma(n_a + n_b - s_a - s_b + 1) as lp from k)
select round(any_value(s_a * (n_b - s_b) / nullif(s_b * (n_a - s_a), 0)), 6) as odds_ratio,
  round(least(1, sum(exp(lp)) filter (lp <= (select min(lp) from l where k = s_a) + 1e-7::double)), 6) as p_value from l""")
def test_fisher(spark, sf_dir):
    r = kernels.fisher(*_counts(spark, sf_dir))
    return _one_row(spark, odds_ratio=round(r["effect"]["value"], 6), p_value=round(r["p_value"], 6))


_EVENTS = """e as (select count(*) filter (event_type = 'click')::double as e_a, count(distinct case when event_type = 'click' then user_id end)::double as x_a,
  count(*) filter (event_type = 'view')::double as e_b, count(distinct case when event_type = 'view' then user_id end)::double as x_b from events)"""


def _rates(spark, sf_dir) -> tuple:
    """Events and the users who had them, of two types."""
    e, u = _table(spark, sf_dir, "events"), F.col("user_id")
    return tuple(e.agg(*[x for k in ("click", "view") for x in (
        F.count_if(F.col("event_type") == k), F.count_distinct(F.when(F.col("event_type") == k, u)).cast("double"))]).first())


@_register("test_poisson", f"""
with {_EVENTS}, n as (select e.*, e_a + e_b as n, x_a / (x_a + x_b) as pi from e), k as (select n.*, unnest(range(0, n::bigint + 1))::double as k from n),
l as (select *, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(pi) + (n - k) * ln(1 - pi) as lp from k)
select round(any_value((e_a / x_a) / (e_b / x_b)), 6) as rate_ratio, round(least(1, sum(exp(lp)) filter (lp <= (select min(lp) from l where k = e_a) + 1e-7::double)), 6) as p_value from l""")
def test_poisson(spark, sf_dir):
    r = kernels.poisson_rates(*_rates(spark, sf_dir))
    return _one_row(spark, rate_ratio=round(r["effect"]["value"], 6), p_value=round(r["p_value"], 6))


@_register("test_negative_binomial", f"""
with {_EVENTS}, b as (select ln((e_a / x_a) / (e_b / x_b)) as beta, sqrt((1 + e_a) / e_a + (1 + e_b) / e_b) as se from e)
select round(exp(beta), 6) as rate_ratio, round(exp(beta - {_Z} * se), 6) as low, round(exp(beta + {_Z} * se), 6) as high, round({_normal_p("(beta / se)")}, 6) as p_value from b""")
def test_negative_binomial(spark, sf_dir):
    r = kernels.negative_binomial(*_rates(spark, sf_dir))
    return _one_row(spark, rate_ratio=round(r["effect"]["value"], 6), low=round(r["effect"]["ci"][0], 6), high=round(r["effect"]["ci"][1], 6), p_value=round(r["p_value"], 6))


@_register("premises", f"""
with {_COUNTS}, v as (select s_a / n_a as p, (s_a + s_b) / (n_a + n_b) as pool, c.* from c), o as (select v.*, least(1, greatest(0, p + 0.05::double)) as q from v),
z as (select o.*, {_Z} as z, 0.8416212335729143::double as y from o)
select round(least(n_a, n_b) * least(pool, 1 - pool), 3) as min_expected,
  ceil(pow(z * sqrt(2 * (p + q) / 2 * (1 - (p + q) / 2)) + y * sqrt(p * (1 - p) + q * (1 - q)), 2) / pow(0.05::double, 2))::double as required_per_group,
  round((z + y) * sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b)), 6) as detectable from z""")
def premises(spark, sf_dir):
    from tallywell.plans import statistics

    c = _counts(spark, sf_dir)
    size = statistics.sample_size(c[1], c[3], c[0] / c[1], 0.05)
    return _one_row(spark, min_expected=statistics.expected_cells(*c).evidence["min_expected"], required_per_group=size.evidence["required_per_group"],
                    detectable=kernels.detectable(c[1], c[3], (c[0] + c[2]) / (c[1] + c[3])))


@_register("missing_pattern", """
select round(avg(case when value is null then 1 else 0 end)::double, 6) as missing_rate, avg(case when value is null then 1 else 0 end) <= 0.05 as passed from events""")
def missing_pattern(spark, sf_dir):
    from tallywell.plans import statistics

    total, missing = _table(spark, sf_dir, "events").agg(F.count("*"), F.count_if(F.col("value").isNull())).first()
    check = statistics.missing_pattern(total, missing)
    return spark.createDataFrame([(check.evidence["missing_rate"], check.passed)], "missing_rate double, passed boolean")


@_register("redact_masks", """
with c as (select c_custkey, lower(c_mktsegment) || '@' || c_custkey || '.example' as email, '+1 (575) ' || (1000000 + c_custkey) as phone,
  'ID' || (100000 + c_custkey) || c_nationkey as id_card, 'No. ' || c_custkey as address from customer)
select c_custkey, left(email, 1) || '***@' || substr(email, strpos(email, '@') + 1) as email, '***' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) as phone,
  left(id_card, 2) || repeat('*', length(id_card) - 4) || right(id_card, 2) as id_card, left(address, 2) || '***' as address from c""")
def redact_masks(spark, sf_dir):
    c = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select(
        c, F.concat(F.lower("c_mktsegment"), F.lit("@"), c, F.lit(".example")).alias("email"), F.concat(F.lit("+1 (575) "), c + 1000000).alias("phone"),
        F.concat(F.lit("ID"), c + 100000, F.col("c_nationkey")).alias("id_card"), F.concat(F.lit("No. "), c).alias("address"))
    return redact(df, {k: "confidential" for k in ("email", "phone", "id_card", "address")} | {"c_custkey": "public"})


@_register("config_diff", """
with n as (select n_nationkey, r_name || '.' || n_name as key from nation join region on n_regionkey = r_regionkey),
b as (select key, count(*)::varchar as before from customer join n on c_nationkey = n_nationkey group by 1),
a as (select key, count(*)::varchar as after from supplier join n on s_nationkey = n_nationkey group by 1)
select coalesce(b.key, a.key) as key, before, after from b full outer join a on b.key = a.key where before is distinct from after""")
def config_diff(spark, sf_dir):
    """Two configurations of counts by region and nation: of customers, and of suppliers."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def tree(table: str, key: str) -> dict:
        out: dict[str, dict] = {}
        for r in _table(spark, sf_dir, table).join(nations, F.col(key) == F.col("n_nationkey")).groupBy("r_name", "n_name").count().collect():  # a row for each nation
            out.setdefault(r["r_name"], {})[r["n_name"]] = r["count"]
        return out

    return governance.config_diff(spark, tree("customer", "c_nationkey"), tree("supplier", "s_nationkey"))


@_register("metric_lineage", """
select * from (select 'paid_orders' as metric, 'o_orderdate' as name, count(o_orderdate) as n from orders union all select 'paid_orders', 'o_orderkey', count(o_orderkey) from orders
  union all select 'paid_orders', 'o_orderstatus', count(o_orderstatus) from orders union all select 'all_orders', 'o_orderdate', count(o_orderdate) from orders
  union all select 'all_orders', 'o_orderkey', count(o_orderkey) from orders union all select 'paid_rate', 'o_orderdate', count(o_orderdate) from orders
  union all select 'paid_rate', 'o_orderkey', count(o_orderkey) from orders union all select 'paid_rate', 'o_orderstatus', count(o_orderstatus) from orders)""")
def metric_lineage(spark, sf_dir):
    """The columns that each metric reads, from its plan, and how many values they hold."""
    orders = _table(spark, sf_dir, "orders")
    read = [(m, c) for m, contract in CONTRACTS.items() for c in sorted(columns_read(compile_metric(orders, contract, CONTRACTS)))]
    names = sorted({c for _, c in read})
    counts = orders.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "name", "n")
    return spark.createDataFrame(read, "metric string, name string").join(F.broadcast(counts), "name").select("metric", "name", "n")


def _gate(spark, df, assertions) -> DataFrame:
    """Every assertion's outcome, whether or not the gate lets the data through."""
    try:
        entries = quality.run_assertions(df, assertions).entries
    except quality.AssertionBlocked as e:
        entries = e.report.entries
    rows = [(e["name"], e["level"], e["blocking"], e["passed"], e["affected_rows"]) for e in entries]
    return spark.createDataFrame(rows, "name string, level string, blocking boolean, passed boolean, affected_rows long")


@_register("gate_default", """
with n as (select count(*) as n from orders), d as (select coalesce(sum(k), 0)::bigint as r, count(*) as g from (select count(*) as k from orders group by o_custkey having count(*) > 1))
select 'row_count_band' as name, 'L1' as level, true as blocking, n * 1.0 between 6.0 / 7 * n * 0.6 and 6.0 / 7 * n * 1.4 as passed, case when n * 1.0 between 6.0 / 7 * n * 0.6 and 6.0 / 7 * n * 1.4 then 0 else n end as affected_rows from n
union all select 'unique:o_custkey', 'L1', true, g = 0, r from d
union all select 'not_null:o_custkey', 'L1', true, count(*) = count(o_custkey), count(*) - count(o_custkey) from orders
union all select 'not_null:o_orderdate', 'L1', true, count(*) = count(o_orderdate), count(*) - count(o_orderdate) from orders
union all select 'enum:o_orderstatus', 'L2', false, count(*) filter (o_orderstatus not in ('F', 'O')) = 0, count(*) filter (o_orderstatus not in ('F', 'O')) from orders""")
def gate_default(spark, sf_dir):
    """Orders under a key that repeats: the gate blocks, and says by how many rows."""
    orders = _table(spark, sf_dir, "orders")
    n = orders.count()
    return _gate(spark, orders, quality.default_assertions(orders.columns, "o_custkey", [0] + [n] * 6, ["o_orderdate", "nowhere"], {"o_orderstatus": ["f", "O"], "nowhere": ["x"]}))


@_register("gate_commerce", """
select 'row_count_band' as name, 'L1' as level, true as blocking, true as passed, 0 as affected_rows
union all select 'unique:order_id', 'L1', true, count(*) = count(distinct o_orderkey), 0 from orders
union all select 'not_null:order_id', 'L1', true, count(*) = count(o_orderkey), count(*) - count(o_orderkey) from orders
union all select 'not_null:created_at', 'L1', true, count(*) = count(o_orderdate), count(*) - count(o_orderdate) from orders
union all select 'enum:status', 'L2', false, count(*) filter (o_orderstatus = 'P') = 0, count(*) filter (o_orderstatus = 'P') from orders""")
def gate_commerce(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "cancelled").otherwise("pending")
    fact = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"))
    return _gate(spark, fact, quality.commerce_assertions(fact))


@_register("gate_research", f"""
select 'row_count_band' as name, 'L1' as level, true as blocking, true as passed, 0 as affected_rows
union all select 'unique:participant_id', 'L1', true, count(*) = count(distinct c_custkey), 0 from customer
union all select 'not_null:participant_id', 'L1', true, count(*) = count(c_custkey), count(*) - count(c_custkey) from customer
union all select 'not_null:arm', 'L1', true, count(*) = count(arm), count(*) - count(arm) from {_ARMS}
union all select 'enum:arm', 'L2', false, count(*) filter (arm not in ('a', 'b')) = 0, count(*) filter (arm not in ('a', 'b')) from {_ARMS}
union all select 'enum:converted', 'L2', false, true, 0""")
def gate_research(spark, sf_dir):
    cohort = _arms(spark, sf_dir).select(F.col("c_custkey").alias("participant_id"), "arm", "converted")
    return _gate(spark, cohort, quality.research_assertions(cohort))


@_register("k_anonymity_summary", """
with g as (select count(*) as n from customer group by c_nationkey, c_mktsegment)
select count(*) filter (n < 15) = 0 as satisfied, min(n) as min_group, count(*) filter (n < 15) as offending_groups, coalesce(sum(n) filter (n < 15), 0)::bigint as affected_rows from g""")
def k_anonymity_summary(spark, sf_dir):
    found = groups.k_anonymity(_table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 15)
    return spark.createDataFrame([tuple(found[k] for k in ("satisfied", "min_group", "offending_groups", "affected_rows"))], "satisfied boolean, min_group long, offending_groups long, affected_rows long")


@_register("analysis_replay", f"""
with {_COUNTS}, v as (select *, s_a / n_a as p, s_b / n_b as q, (s_a + s_b) / (n_a + n_b) as pool from c), t as (select *, (p - q) / nullif(sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b)), 0) as z from v)
select 'customers#effect' as period, round(p - q, 6) as value, 'PASS' as status, 'GREEN' as colour from t union all select 'customers#p_value', round({_normal_p("z")}, 6), 'PASS', 'GREEN' from t""")
def analysis_replay(spark, sf_dir):
    """A two-proportion analysis of all customers, its claims held against a recomputation from the data."""
    from tallywell.plans.statistics import analyze, replay_stat

    source = {"query_id": "q", "run_id": "r", "snapshot_id": "s"}
    told = analyze("binary", "rct", "commerce", counts=_counts(spark, sf_dir), period="customers", source=source)
    checked = claims.reconcile(told["claims"], replay_stat(told, _counts(spark, sf_dir)))
    return spark.createDataFrame([(e["period"], round(e["value"], 6), e["status"], told["status"]) for e in checked["entries"]], "period string, value double, status string, colour string")


@_register("experiment_whole", f"""
with {_COUNTS}, v as (select *, n_a + n_b as n, s_a / n_a as p, s_b / n_b as q, (s_a + s_b) / (n_a + n_b) as pool from c),
t as (select *, (p - q) / nullif(sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b)), 0) as z from v),
r as (select *, {_normal_p("z")} as pv, (pow(n_a - n / 2, 2) + pow(n_b - n / 2, 2)) / (n / 2) as chi2 from t),
g as (select avg(case when event_id % 2 = 0 then value end) as b, avg(case when event_id % 2 = 1 then value end) as v from events where event_type = 'click')
select round(chi2, 6) as chi2, round({_normal_p("sqrt(chi2)")}, 6) as ratio_p, round(p - q, 6) as effect, round(pv, 6) as p_value, pv < 0.025::double as significant,
  v - b > 0.5::double as broken, case when v - b > 0.5::double then 'a guardrail is broken' when pv < 0.025::double then 'significant' else 'not significant' end as verdict from r, g""")
def experiment_whole(spark, sf_dir):
    """Sample ratio, two looks, the test and a guardrail, over all customers."""
    from tallywell.plans.experiments import Design, evaluate

    even = F.col("event_id") % 2 == 0
    values = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.avg(F.when(even, F.col("value"))).alias("baseline"), F.avg(F.when(~even, F.col("value"))).alias("variant"))
    rails = spark.createDataFrame([("click", "not_increase", 0.5)], "name string, direction string, threshold double")
    e = evaluate(_arms(spark, sf_dir), "arm", "converted", Design({"a": 0.5, "b": 0.5}, control="b", variant="a", looks=2), rails, values)
    found = e.conclusion["result"]
    row = (round(e.ratio.chi2, 6), round(e.ratio.p_value, 6), round(found["effect"]["value"], 6), round(found["p_value"], 6), e.significant, bool(e.broken), e.verdict)
    return spark.createDataFrame([row], "chi2 double, ratio_p double, effect double, p_value double, significant boolean, broken boolean, verdict string")


@_register("smallest_groups", "select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2 having count(*) < 10 order by n, 1, 2")
def smallest_groups(spark, sf_dir):
    return groups.smallest_groups(_table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 10)


QUERIES |= audit_queries.QUERIES | store_queries.QUERIES
ORACLES |= audit_queries.ORACLES | store_queries.ORACLES
