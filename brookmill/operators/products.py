"""Most clicked products of each area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import area_level, concat_long_string, group_concat_distinct, product_status


def click_product_basic(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks with the name and area of their city; Spark broadcasts the cities if they are small."""
    return clicks.join(cities.select("city_id", "city_name", "area"), "city_id").select("city_id", "city_name", "area", "product_id")


def area_product_click_count(basic: DataFrame) -> DataFrame:
    """Clicks of each product in each area, with the distinct ``id:name`` list of its cities.

    Counted by city first, so that the list is built from a few rows, not from all clicks.
    """
    by_city = basic.groupBy("area", "product_id", "city_id", "city_name").agg(F.count("*").alias("n"))
    city = concat_long_string(F.col("city_id"), ":", F.col("city_name"))
    return by_city.groupBy("area", "product_id").agg(F.sum("n").alias("click_count"), group_concat_distinct(city).alias("city_infos"))


def area_full_product(counts: DataFrame, products: DataFrame) -> DataFrame:
    wanted = products.select("product_id", "product_name", product_status(F.col("extend_info")).alias("product_status"))
    return counts.join(wanted, "product_id").select("area", "product_id", "click_count", "city_infos", "product_name", "product_status")


def area_top3_product(full: DataFrame, n: int = 3) -> DataFrame:
    """The n most clicked products of each area; equal counts go by id.  Spark cuts the groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("click_count"), "product_id"))
    best = full.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.select("area", area_level(F.col("area")).alias("area_level"), "product_id", "city_infos", "click_count", "product_name", "product_status")
