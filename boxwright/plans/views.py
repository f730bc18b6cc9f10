"""The test tables as boxes, as DataFrames and as DuckDB common table expressions of the same rows.

Axes are integer-valued doubles, so that predicates, sums and orders agree bit for bit between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"


def _day(name: str) -> Column:
    return F.datediff(F.to_date(name), F.lit(EPOCH).cast("date")).cast("double")


def _day_sql(name: str) -> str:
    return f"CAST(date_diff('day', DATE '{EPOCH}', CAST({name} AS DATE)) AS DOUBLE)"


def li(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as 3-D boxes: quantity, shipping days, price in hundreds."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    day, n, price = _day("l_shipdate"), F.col("l_linenumber"), F.floor(F.col("l_extendedprice") / 100).cast("double")
    rid = ((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + n
    return t.select(rid.alias("rid"), F.col("l_quantity").alias("x0_l"), (F.col("l_quantity") + n).alias("x0_h"), day.alias("x1_l"), (day + n * 5).alias("x1_h"), price.alias("x2_l"), (price + n).alias("x2_h"))


LI = f"""li AS (SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS rid,
  l_quantity AS x0_l, l_quantity + l_linenumber AS x0_h, {_day_sql('l_shipdate')} AS x1_l, {_day_sql('l_shipdate')} + 5 * l_linenumber AS x1_h,
  CAST(floor(l_extendedprice / 100) AS DOUBLE) AS x2_l, CAST(floor(l_extendedprice / 100) AS DOUBLE) + l_linenumber AS x2_h FROM lineitem)"""


def pq(spark: SparkSession, d: str) -> DataFrame:
    """part as 2-D query boxes; every third lies outside the data and hits nothing."""
    t = spark.read.parquet(f"{d}/part.parquet")
    size, day = F.col("p_size").cast("double"), ((F.col("p_partkey") * 37) % 2400).cast("double") + F.when(F.col("p_partkey") % 3 == 0, 100000.0).otherwise(0.0)
    return t.select(F.col("p_partkey").alias("qid"), size.alias("x0_l"), (size + 2).alias("x0_h"), day.alias("x1_l"), (day + 20).alias("x1_h"))


PQ = """pq AS (SELECT qid, x0_l, x0_l + 2 AS x0_h, x1_l, x1_l + 20 AS x1_h FROM (SELECT p_partkey AS qid, CAST(p_size AS DOUBLE) AS x0_l,
  CAST((p_partkey * 37) % 2400 AS DOUBLE) + CASE WHEN p_partkey % 3 = 0 THEN 100000.0 ELSE 0.0 END AS x1_l FROM part))"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    """orders as 1-D intervals of days."""
    t = spark.read.parquet(f"{d}/orders.parquet")
    day = _day("o_orderdate")
    return t.select(F.col("o_orderkey").alias("rid"), day.alias("x0_l"), (day + F.col("o_orderkey") % 7).alias("x0_h"))


ORD = f"ord AS (SELECT o_orderkey AS rid, {_day_sql('o_orderdate')} AS x0_l, {_day_sql('o_orderdate')} + o_orderkey % 7 AS x0_h FROM orders)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """events as 2-D points: value and user."""
    t = spark.read.parquet(f"{d}/events.parquet")
    v, u = F.floor("value").cast("double"), F.col("user_id").cast("double")
    return t.select(F.col("event_id").alias("rid"), "user_id", v.alias("x0_l"), v.alias("x0_h"), u.alias("x1_l"), u.alias("x1_h"))


EV = "ev AS (SELECT event_id AS rid, user_id, CAST(floor(value) AS DOUBLE) AS x0_l, CAST(floor(value) AS DOUBLE) AS x0_h, CAST(user_id AS DOUBLE) AS x1_l, CAST(user_id AS DOUBLE) AS x1_h FROM events)"


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """supplier as 2-D points to search from."""
    t = spark.read.parquet(f"{d}/supplier.parquet")
    return t.select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") * 7 % 490).cast("double").alias("p0"), (F.col("s_suppkey") * 13 % 150).cast("double").alias("p1"))


SUP = "sup AS (SELECT s_suppkey AS qid, CAST(s_suppkey * 7 % 490 AS DOUBLE) AS p0, CAST(s_suppkey * 13 % 150 AS DOUBLE) AS p1 FROM supplier)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    """customer as 2-D boxes: balance and nation."""
    t = spark.read.parquet(f"{d}/customer.parquet")
    b = F.floor(F.col("c_acctbal") / 10).cast("double")
    n = F.col("c_nationkey").cast("double")
    w = (F.col("c_custkey") % 5).cast("double")
    return t.select(F.col("c_custkey").alias("rid"), b.alias("x0_l"), (b + w).alias("x0_h"), n.alias("x1_l"), (n + F.col("c_custkey") % 2).alias("x1_h"))


CUST = "cust AS (SELECT c_custkey AS rid, CAST(floor(c_acctbal / 10) AS DOUBLE) AS x0_l, CAST(floor(c_acctbal / 10) AS DOUBLE) + c_custkey % 5 AS x0_h, CAST(c_nationkey AS DOUBLE) AS x1_l, CAST(c_nationkey AS DOUBLE) + c_custkey % 2 AS x1_h FROM customer)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """li with a node number from a plain grid, the same in both engines."""
    return li(spark, d).withColumn("node_id", (F.floor(F.col("x0_l") / 2) * 1000 + F.floor(F.col("x1_l") / 50)).cast("long"))


ND = LI + ", nd AS (SELECT *, CAST(floor(x0_l / 2) * 1000 + floor(x1_l / 50) AS BIGINT) AS node_id FROM li)"
