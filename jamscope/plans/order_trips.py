"""A trip table derived from order tables, for studies on TPC-H-like data.

A projection over four joined tables; it carries the defects a raw trip table
has (one block of missing values, sentinel codes, impossible durations).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jamscope.config import CleaningRules, ColumnMap, StudyConfig
from jamscope.sources.tables import read_table

ORDER_TRIP_COLUMNS = ColumnMap(
    pickup="pickup_ts",
    dropoff="dropoff_ts",
    pu_zone="pu_zone",
    do_zone="do_zone",
    vendor="vendor_id",
    ratecode="ratecode_id",
    distance="trip_distance",
    passengers="passenger_count",
    fare="fare_amount",
    tip="tip_amount",
    total="total_amount",
)

ORDER_TRIP_RULES = CleaningRules(
    period_start=dt.datetime(1996, 1, 1),
    period_end=dt.datetime(2001, 1, 1),
    max_distance=9.9,
    max_same_zone_distance=9.0,
    unknown_zones=(23, 24),
)


def order_trip_config(min_route_trips: int = 10) -> StudyConfig:
    return StudyConfig(
        columns=ORDER_TRIP_COLUMNS,
        cleaning=ORDER_TRIP_RULES,
        min_route_trips=min_route_trips,
    )


def order_trips(spark: SparkSession, directory: str) -> DataFrame:
    """One trip per order line.  Orders, customers and suppliers are broadcast only if the planner
    finds them small.  Orders meet their customers first, so that the lines move once."""

    def table(name: str) -> DataFrame:
        return read_table(spark, f"{directory.rstrip('/')}/{name}.parquet")

    orders = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = (
        table("lineitem")
        .join(
            orders.select("o_orderkey", "o_orderdate", "c_nationkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    in_block = F.col("l_returnflag") == "R"
    parity = supp % 2

    def outside_block(value):
        return F.when(~in_block, value)

    pickup = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (part % 24).cast("int"))
    minutes = ((part * 7 + supp * 13 + line * 31) % 200 - 5).cast("int")
    return lines.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        pickup.alias("pickup_ts"),
        (pickup + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("dropoff_ts"),
        F.col("c_nationkey").alias("pu_zone"),
        F.col("s_nationkey").alias("do_zone"),
        F.when(in_block, 1 + 5 * parity)
        .when(F.col("l_returnflag") == "A", 1 + 6 * parity)
        .otherwise(1 + parity)
        .alias("vendor_id"),
        outside_block(line).alias("passenger_count"),
        outside_block(F.when(part % 29 == 0, F.lit(99)).otherwise(1 + part % 6)).alias(
            "ratecode_id"
        ),
        outside_block(F.col("l_linestatus")).alias("store_flag"),
        (F.col("l_quantity") / 5).alias("trip_distance"),
        F.when(part % 97 == 0, -price).otherwise(price).alias("fare_amount"),
        (price * tax).alias("tip_amount"),
        (price * (1 + tax)).alias("total_amount"),
    )
