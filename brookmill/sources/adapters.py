"""The shop tables as views of the star schema with its event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DATE, TIME
from .readers import between_dates

#: Regions as areas.
AREA_OF_REGION = {
    "AFRICA": "China North",
    "AMERICA": "China East",
    "ASIA": "China South",
    "EUROPE": "West North",
    "MIDDLE EAST": "Northeast",
}


def _events(spark: SparkSession, sf_dir: str, dates: tuple[str, str] | None = None) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dates:  # bounds on the stored column, for the scan
        events = events.where(between_dates(F.col("ts"), events.schema["ts"].dataType.simpleString(), *dates))
    return events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def user_visit_action(spark: SparkSession, sf_dir: str, dates: tuple[str, str] | None = None) -> DataFrame:
    """Actions of the event stream, of all ``dates`` or from the first to the second; ``event_id`` is
    kept to order actions of one second."""
    kind, k = F.col("event_type"), F.col("k")
    text = lambda c: c.cast("string")
    date = F.date_format("ts", DATE)
    return _events(spark, sf_dir, dates).select(
        date.alias("date"),
        "user_id",
        F.concat_ws("_", text(F.col("user_id")), date).alias("session_id"),
        (k % 10).alias("page_id"),
        F.date_format("ts", TIME).alias("action_time"),
        F.when(kind == "view", F.concat(F.lit("kw"), text(k % 20))).alias("search_keyword"),
        F.when(kind == "click", k % 20).alias("click_category_id"),
        F.when(kind == "click", k).alias("click_product_id"),
        F.when(kind == "purchase", F.concat_ws(",", text(k % 20), text((k + 7) % 20))).alias("order_category_ids"),
        F.when(kind == "purchase", F.concat_ws(",", text(k), text((k + 7) % 100))).alias("order_product_ids"),
        F.when(kind == "signup", text(k % 20)).alias("pay_category_ids"),
        F.when(kind == "signup", text(k)).alias("pay_product_ids"),
        (F.col("user_id") % 25).alias("city_id"),
        "event_id",
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_name").alias("name"), (F.lit(18) + F.col("c_custkey") % 50).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"), F.concat(F.lit("city"), F.col("c_nationkey").cast("string")).alias("city"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    info = F.concat(F.lit('{"product_status": '), (F.col("p_size") % 2).cast("string"), F.lit("}"))
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), info.alias("extend_info"))


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    area = F.col("r_name")
    for name, new in AREA_OF_REGION.items():
        area = F.when(F.col("r_name") == name, new).otherwise(area)
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint").alias("city_id"), F.col("n_name").alias("city_name"), area.alias("area"))


def ad_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a click on an ad, with its city and province; ``event_id`` orders equal times."""
    events = _events(spark, sf_dir).withColumn("city_id", F.col("user_id") % 25)
    located = events.join(city_info(spark, sf_dir), "city_id")
    return located.select("ts", F.col("area").alias("province"), F.col("city_name").alias("city"), "user_id", (F.col("k") % 10).alias("ad_id"), "event_id")


def purchases_as_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, city_id, product_id) of all order lines: the large variant of product clicks."""
    line, orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    buyers = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = line.select("l_orderkey", "l_partkey", "l_shipdate").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.date_format("l_shipdate", DATE).alias("date"), F.col("c_nationkey").cast("bigint").alias("city_id"), F.col("l_partkey").alias("product_id"))
