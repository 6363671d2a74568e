"""The monitoring model's tables as views of the star schema, in Spark and as SQL.

panel: one row per nation and month of order (cell, month) with pooled prices; scenes and pixels: order lines with class
codes of two classifiers; observations: events by user and day; series: the panel pooled by month.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import cached, fingerprint
from .storage import shared_dir

LEAST_FRACTION = 0.4  # a cell-month is valid with so much of its cell's largest number of lines; the rest are gaps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    return F.col(c).cast("decimal(18,2)")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order's month and nation."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    o = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("cell"), F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", "o_orderstatus")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(F.col("l_returnflag") == "R", cents("l_extendedprice")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return lines(spark, sf_dir).groupBy("cell", "month").agg(
        F.sum(cents("l_extendedprice")).cast("double").alias("valid"), F.sum(r).cast("double").alias("target"), F.count("*").alias("n_pixels"),
        (F.sum(F.when(F.col("l_tax") > 0, cents("l_tax"))).cast("double") / F.count(F.when(F.col("l_tax") > 0, 1))).alias("driver"), F.sum(cents("l_quantity")).cast("double").alias("rain"),
    ).withColumn("cover", F.col("target") / F.col("valid"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid cell-months."""
    fraction = F.col("n_pixels") / F.max("n_pixels").over(Window.partitionBy("cell"))
    return full_panel(spark, sf_dir).withColumn("_f", fraction).filter(F.col("_f") >= LEAST_FRACTION).drop("_f")


def panel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a table, for queries that read it more than once: lines are scanned and joined once in a session, as long as the tables' files
    stay what they are. The table goes when the session ends."""
    made_of = [spark.sparkContext.applicationId, *(fingerprint(spark, f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "customer"))]
    key = uuid.uuid5(uuid.NAMESPACE_OID, "|".join(made_of)).hex
    return cached(spark, f"{shared_dir(spark)}/panel", key, lambda: panel(spark, sf_dir))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels: scene (priority as sensor, month), class of the model and of the rule, probability."""
    q = F.col("l_quantity")
    return lines(spark, sf_dir).select(
        F.when(F.substring("o_orderpriority", 1, 1) <= "2", "S2").otherwise("S1").alias("sensor"), "month", "day", "cell", F.col("l_orderkey").alias("pixel"), F.col("l_linenumber").alias("layer"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("model"),
        F.when(q > 35, 2).when(q > 15, 1).otherwise(0).alias("rule"),
        F.when(F.col("l_tax") > 0, F.round(100 * (1 - cents("l_discount")), 0).cast("int")).alias("probability"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("obs"), F.col("user_id").alias("point"), F.col("ts").cast("date").alias("day"), "ts", "event_type", "value")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").alias("region"))


LINES = """lines AS (
    SELECT l.*, c_nationkey AS cell, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_orderstatus
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

FULL = LINES + """, full_panel AS (
    SELECT *, target / valid AS cover FROM (
        SELECT cell, month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS valid,
            CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS target, count(*) AS n_pixels,
            CAST(sum(CASE WHEN l_tax > 0 THEN CAST(l_tax AS DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN l_tax > 0 THEN 1 END) AS driver,
            CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS rain
        FROM lines GROUP BY cell, month))"""

PANEL = FULL + f""", panel AS (SELECT *, CAST(year(month) * 12 + month(month) - 1 AS INT) AS mi FROM full_panel QUALIFY n_pixels / max(n_pixels) OVER (PARTITION BY cell) >= {LEAST_FRACTION})"""

PIXELS = LINES + """, pixels AS (
    SELECT CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 'S2' ELSE 'S1' END AS sensor, month, day, cell, l_orderkey AS pixel, l_linenumber AS layer,
        CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS model,
        CASE WHEN l_quantity > 35 THEN 2 WHEN l_quantity > 15 THEN 1 ELSE 0 END AS rule,
        CASE WHEN l_tax > 0 THEN CAST(round(100 * (1 - CAST(l_discount AS DECIMAL(18,2))), 0) AS INT) END AS probability
    FROM lines)"""

OBS = """obs AS (SELECT event_id AS obs, user_id AS point, CAST(ts AS DATE) AS day, ts, event_type, value FROM events)"""

REGIONS = """regions AS (SELECT n_nationkey AS cell, n_regionkey AS region FROM nation)"""
