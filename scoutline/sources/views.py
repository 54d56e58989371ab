"""Domain views over the catalogue's tables: productions, places, and the links between them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Operators cut lineage with checkpoint(), into the folder that the cluster names. A local session without one gets a temporary
    folder; elsewhere Spark says that none is set."""
    context = spark.sparkContext
    if context.master.startswith("local") and not context.getConf().get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scoutline-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoints(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def production(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("production_id"), "o_custkey")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("genre"), F.col("c_name").alias("director"))
    return orders.join(customer, "o_custkey").drop("o_custkey")


def location(spark: SparkSession, d: str) -> DataFrame:
    supplier, nation, region = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("name"), F.col("n_name").alias("province"), F.col("r_name").alias("macro_region"),
        (36.0 + (F.col("s_nationkey") % 5) * 1.2 + ((F.col("s_suppkey") * 7919) % 1000) / 5000.0).alias("lat"),
        (26.0 + F.floor(F.col("s_nationkey") / 5) * 3.5 + ((F.col("s_suppkey") * 104729) % 1000) / 5000.0).alias("lon"),
    )


def bridge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("production_id"), F.col("l_suppkey").alias("location_id")).distinct()


def item_bridge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("production_id"), F.col("l_partkey").alias("item_id")).distinct()


def item(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("province"), F.col("p_name").alias("text"))


#: The same views for the SQL that results are held against.
SQL = """production as (select o_orderkey as production_id, c_mktsegment as genre, c_name as director from orders join customer on o_custkey = c_custkey),
location as (select s_suppkey as location_id, s_name as name, n_name as province, r_name as macro_region,
  36.0::double + (s_nationkey % 5) * 1.2::double + ((s_suppkey * 7919) % 1000) / 5000.0::double as lat,
  26.0::double + floor(s_nationkey / 5) * 3.5::double + ((s_suppkey * 104729) % 1000) / 5000.0::double as lon
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
bridge as (select distinct l_orderkey as production_id, l_suppkey as location_id from lineitem),
item_bridge as (select distinct l_orderkey as production_id, l_partkey as item_id from lineitem),
item as (select p_partkey as item_id, p_brand as province, p_name as text from part)"""
