"""Category popularity and the most active sessions of the top categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import csv_to_longs


def _ids(text: str, kind: str) -> Column:
    wrap = F.transform(csv_to_longs(F.col(text)), lambda x: F.struct(x.alias("category_id"), F.lit(kind).alias("kind")))
    return F.coalesce(wrap, F.array().cast("array<struct<category_id:bigint,kind:string>>"))


def _events(details: DataFrame) -> DataFrame:
    """(category_id, kind): every click, ordered id and paid id, in one pass over the details."""
    click = F.struct(F.col("click_category_id").alias("category_id"), F.lit("click").alias("kind"))
    every = F.concat(F.array(click), _ids("order_category_ids", "order"), _ids("pay_category_ids", "pay"))
    return details.select(F.explode(every).alias("e")).select("e.*").where("category_id is not null")


def category_universe(details: DataFrame) -> DataFrame:
    return _events(details).select("category_id").distinct()


def click_category_counts(details: DataFrame) -> DataFrame:
    return details.where("click_category_id is not null").groupBy(F.col("click_category_id").alias("category_id")).agg(F.count("*").alias("click_count"))


def _id_counts(details: DataFrame, text: str, name: str) -> DataFrame:
    ids = details.where(F.col(text).isNotNull()).select(F.explode(csv_to_longs(F.col(text))).alias("category_id"))
    return ids.where("category_id is not null").groupBy("category_id").agg(F.count("*").alias(name))


def order_category_counts(details: DataFrame) -> DataFrame:
    return _id_counts(details, "order_category_ids", "order_count")


def pay_category_counts(details: DataFrame) -> DataFrame:
    return _id_counts(details, "pay_category_ids", "pay_count")


def category_counts(details: DataFrame) -> DataFrame:
    """Clicks, orders and payments of every category side by side."""
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("click", "order", "pay")]
    return _events(details).groupBy("category_id").agg(*counts)


def top10_category(details: DataFrame, n: int = 10) -> DataFrame:
    order = [F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), F.asc("category_id")]
    return category_counts(details).orderBy(*order).limit(n)


def top10_session(details: DataFrame, top: DataFrame, n: int = 10) -> DataFrame:
    """The n sessions with most clicks in each category of ``top`` (at most a few rows)."""
    clicks = details.where("click_category_id is not null").select(F.col("click_category_id").alias("category_id"), "session_id")
    counts = clicks.join(F.broadcast(top.select("category_id")), "category_id").groupBy("category_id", "session_id").agg(F.count("*").alias("click_count"))
    rank = F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("category_id", "session_id", "click_count")
