"""Queries on events and on the star schema: windows, sessions, set operations, joins and cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakb.session import table


def events_tumbling(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "value")


def events_sliding(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events").groupBy(F.window("ts", "1 day", "12 hours").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "events", "users")


def events_sessions(spark: SparkSession, at: str) -> DataFrame:
    """Sessions of a user end after 30 minutes without an event."""
    e = table(spark, at, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


def events_dedup(spark: SparkSession, at: str) -> DataFrame:
    """The first event of each user, type and day."""
    first = Window.partitionBy("user_id", "event_type", "day").orderBy("ts", "event_id")
    e = table(spark, at, "events").withColumn("day", F.to_date("ts"))
    return e.withColumn("n", F.row_number().over(first)).where("n = 1").select("user_id", "event_type", "day", "event_id")


def events_hits(spark: SparkSession, at: str) -> DataFrame:
    """Users by hits and distinct days, with those that reach three hits on two days."""
    e = table(spark, at, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(F.to_date("ts")).alias("days"))
    return e.withColumn("promoted", (F.col("hits") >= 3) & (F.col("days") >= 2))


def events_json(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.count("k").alias("filled"))


def star_join_agg(spark: SparkSession, at: str) -> DataFrame:
    l, o, c, n = (table(spark, at, x) for x in ("lineitem", "orders", "customer", "nation"))
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nation has 25 rows at every scale
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


def top_customers(spark: SparkSession, at: str) -> DataFrame:
    """The three orders of the highest price of each customer."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, at, "orders").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def semi_anti_orders(spark: SparkSession, at: str) -> DataFrame:
    """Customers with and without orders, per nation."""
    c, o = table(spark, at, "customer"), table(spark, at, "orders").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(o, "c_custkey", "left_semi").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("ordering"))
    lacks = c.join(o, "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("idle"))
    return has.join(lacks, "c_nationkey", "full").select("c_nationkey", F.coalesce("ordering", F.lit(0)).alias("ordering"), F.coalesce("idle", F.lit(0)).alias("idle"))


def cube_sales(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def setops_parts(spark: SparkSession, at: str) -> DataFrame:
    """Parts sold in quantities under 5 and over 45, and those that were sold in neither."""
    l = table(spark, at, "lineitem")
    low, high = l.where("l_quantity < 5").select("l_partkey"), l.where("l_quantity > 45").select("l_partkey")
    both = low.intersect(high).select(F.lit("both").alias("set"), "l_partkey")
    neither = table(spark, at, "part").select(F.col("p_partkey").alias("l_partkey")).subtract(low.union(high)).select(F.lit("neither").alias("set"), "l_partkey")
    return both.union(neither).groupBy("set").agg(F.count(F.lit(1)).alias("parts"), F.sum("l_partkey").alias("keys"))


def running_revenue(spark: SparkSession, at: str) -> DataFrame:
    """Revenue by month with its change and running sum within each flag."""
    month = F.date_trunc("MONTH", "l_shipdate").cast("date")
    m = table(spark, at, "lineitem").groupBy("l_returnflag", month.alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    w = Window.partitionBy("l_returnflag").orderBy("month")
    return m.select("l_returnflag", "month", "revenue", F.round(F.col("revenue") - F.lag("revenue").over(w), 2).alias("change"), F.round(F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_sessions, events_dedup, events_hits, events_json, star_join_agg, top_customers, semi_anti_orders, cube_sales, setops_parts, running_revenue)}

ORACLE = {
    "events_tumbling": "select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 2) as value from events group by 1, 2",
    "events_sliding": """with w as (select user_id, unnest([time_bucket(interval '12 hours', ts, timestamp '1970-01-01'), time_bucket(interval '12 hours', ts, timestamp '1970-01-01') - interval '12 hours']) as start from events)
      select start, count(*) as events, count(distinct user_id) as users from w group by 1""",
    "events_sessions": """with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
      select user_id, min(ts) as start, count(*) as events from s group by user_id, n""",
    "events_dedup": "select user_id, event_type, day, event_id from (select *, ts::date as day, row_number() over (partition by user_id, event_type, ts::date order by ts, event_id) as n from events) where n = 1",
    "events_hits": "select user_id, count(*) as hits, count(distinct ts::date) as days, count(*) >= 3 and count(distinct ts::date) >= 2 as promoted from events group by 1",
    "events_json": "select event_type, sum((props->>'$.k')::bigint)::bigint as total, max((props->>'$.k')::bigint) as most, count(props->>'$.k') as filled from events group by 1",
    "star_join_agg": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "top_customers": "select o_custkey, o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3",
    "semi_anti_orders": "select c_nationkey, count(*) filter (c_custkey in (select o_custkey from orders)) as ordering, count(*) filter (c_custkey not in (select o_custkey from orders)) as idle from customer group by 1",
    "cube_sales": "select l_returnflag, l_linestatus, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)",
    "setops_parts": """with low as (select l_partkey from lineitem where l_quantity < 5), high as (select l_partkey from lineitem where l_quantity > 45)
      select 'both' as set, count(*) as parts, sum(l_partkey)::bigint as keys from (select * from low intersect select * from high) having count(*) > 0 union all
      select 'neither', count(*), sum(p_partkey)::bigint from (select p_partkey from part except (select * from low union select * from high)) having count(*) > 0""",
    "running_revenue": """with m as (select l_returnflag, date_trunc('month', l_shipdate)::date as month, round(sum(l_extendedprice), 2) as revenue from lineitem group by 1, 2)
      select *, round(revenue - lag(revenue) over w, 2) as change, round(sum(revenue) over (w rows unbounded preceding), 2) as running from m window w as (partition by l_returnflag order by month)""",
}
