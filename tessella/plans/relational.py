"""Joins, sets, windows and streams over the star schema and events (extensions beside the reference's operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import splits
from tessella.plans.registry import query
from tessella.sources.tables import load
from tessella.streaming import events as stream
from tessella.streaming import state


@query("with patch as (select c_custkey, 'patched' as c_mktsegment, row_number() over (order by c_custkey) as pos from customer where c_custkey % 10 = 0) select c.c_custkey, coalesce(p.c_mktsegment, c.c_mktsegment) as c_mktsegment from customer c left join patch p using (c_custkey)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("pos"))
    patch = base.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("patched"))
    return splits.upsert(base, patch, "c_custkey", "pos").select("c_custkey", "c_mktsegment")


@query("select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)")
def tpch_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select n_name, count(*) as customers, cast(sum(orders) as bigint) as orders from (select c_custkey, n_name, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey join nation on c_nationkey = n_nationkey group by 1, 2) group by 1")
def tpch_nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    named = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(orders, "c_custkey", "left").groupBy("n_name").agg(F.count("*").alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))


@query("select c_custkey from customer anti join orders on c_custkey = o_custkey")
def tpch_customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select o_orderkey from orders semi join (select l_orderkey from lineitem where l_quantity >= 45) on o_orderkey = l_orderkey")
def tpch_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem").where("l_quantity >= 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("select o_custkey, o_orderkey, row_number() over w as nth, round(o_totalprice - lag(o_totalprice) over w, 2) as change from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def tpch_order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_changes(load(spark, sf_dir, "orders"))


def _order_changes(orders: DataFrame) -> DataFrame:
    over = "over (partition by o_custkey order by o_orderdate, o_orderkey)"
    return orders.select("o_custkey", "o_orderkey", F.expr(f"cast(row_number() {over} as bigint)").alias("nth"), F.expr(f"round(o_totalprice - lag(o_totalprice) {over}, 2)").alias("change"))


@query("select e.event_id, o.event_id as before_id from events e asof left join (select event_id, user_id, ts from events where event_type = 'signup') o on e.user_id = o.user_id and e.ts >= o.ts where e.event_type = 'purchase'")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.as_of(load(spark, sf_dir, "events"), "purchase", "signup")


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(load(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("select event_type, s as start, count(*) as n from (select event_type, ts, time_bucket(interval '15 minutes', ts) - to_minutes(15 * i) as s from events, unnest(range(4)) as t(i)) where ts < s + interval '1 hour' group by 1, 2")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sliding(load(spark, sf_dir, "events"), "1 hour", "15 minutes")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, session")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(load(spark, sf_dir, "events"), "30 minutes")


@query("select user_id, event_type, min(ts) as first_ts, count(*) as n from events group by 1, 2")
def events_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.first_seen(load(spark, sf_dir, "events"))


@query("select distinct user_id, event_type from events")
def events_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and what they did, once each: the operator that drops repeats within the watermark of a stream."""
    return stream.dedup(load(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("select user_id as key, event_id as event, row_number() over (partition by user_id order by ts, event_id) as n, row_number() over (partition by user_id order by ts, event_id) <= 20 as allowed from events")
def events_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by number, and whether they are within a budget of 20."""
    return state.budget(load(spark, sf_dir, "events"), "user_id", 20)


@query("select user_id as key, event_id as event, coalesce(sum(cast(value < 50 as int)) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding), 0) = 3 as open from events")
def events_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's last three events all fell below 50."""
    return state.breaker(load(spark, sf_dir, "events"), "user_id", F.col("value") < 50)


@query("with r as (select conv_id, sum(length(coalesce(text, ''))) over (partition by conv_id order by turn desc rows unbounded preceding) <= 2000 as fits from conversations) select conv_id, count(*) filter (where fits) as kept, count(*) filter (where not fits) as dropped from r group by 1")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a conversation's last turns fit 2000 characters."""
    return state.compressed(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2000)
