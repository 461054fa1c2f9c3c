"""Where queries register, and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with SQL for DuckDB if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPK = "spk AS (SELECT user_id AS neuron, epoch_us(ts) AS t_us, event_id, event_type, value FROM events)"


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spikes: neuron, time in microseconds, event id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("neuron"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "event_id", "event_type", "value")


def neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("neuron"))


EDGE = """edge AS (SELECT o_custkey AS src, l_suppkey AS dst, round(avg(l_discount), 8) AS weight, 1 + count(*) % 5 AS delay, min(l_returnflag) AS proto
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey)"""
ORD = EDGE + ", ord AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS ordinal FROM edge)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers connected to the suppliers of their orders."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = o.select("o_orderkey", F.col("o_custkey").alias("src")).join(li.select("l_orderkey", F.col("l_suppkey").alias("dst"), "l_discount", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("src", "dst").agg(F.round(F.avg("l_discount"), 8).alias("weight"), (1 + F.count("*") % 5).alias("delay"), F.min("l_returnflag").alias("proto"))
