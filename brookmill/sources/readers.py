"""Sources: tables, control-A text, JDBC, and the ad stream."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A catalog table, or ``name``.parquet below ``path``."""
    return spark.table(name) if path is None else spark.read.parquet(f"{path}/{name}.parquet")


def actions_by_date(actions: DataFrame, start: str, end: str) -> DataFrame:
    """Actions of the dates from ``start`` to ``end``, both included; prunes partitions by date."""
    return actions.where(F.col("date").between(start, end))


def between_dates(time: Column, kind: str, start: str, end: str) -> Column:
    """The time lies on a date from ``start`` to ``end``, both included.

    The bounds are constants of the stored column's own type (``kind``), so the source can use
    them: a comparison with a text made from the time would not reach it.
    """
    first, after = (F.lit(d).cast(kind) for d in (start, str(date.fromisoformat(end) + timedelta(days=1))))
    return (time >= first) & (time < after)


def write_by_date(actions: DataFrame, path: str) -> None:
    """Actions in a folder for each date, as ``actions_by_date`` prunes them."""
    actions.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(path)


def read_by_date(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_by_date`` wrote; the schema keeps the date a text."""
    return spark.read.schema(schema).parquet(path)


def click_actions_by_date(actions: DataFrame, start: str, end: str) -> DataFrame:
    """(city_id, product_id) of the product clicks of those dates."""
    clicks = actions_by_date(actions, start, end).where(F.col("click_product_id").isNotNull())
    return clicks.select("city_id", F.col("click_product_id").alias("product_id"))


def read_ctrl_a(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Text files with fields parted by the character 1 and nulls written ``null``."""
    return spark.read.csv(path, sep="\x01", nullValue="null", quote="", schema=schema)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table over JDBC; with a partition column and its bounds, read by that many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def parse_ad_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Columns of ``millis province city user ad`` lines; what can't be read is null."""
    part = F.split(F.col(col), " ")

    def at(i: int) -> Column:
        return F.get(part, i)

    millis = at(0).try_cast("bigint")
    return lines.select(F.timestamp_millis(millis).alias("ts"), at(1).alias("province"), at(2).alias("city"), at(3).try_cast("bigint").alias("user_id"), at(4).try_cast("bigint").alias("ad_id"))


def read_ad_stream_kafka(spark: SparkSession, brokers: str, topics: str) -> DataFrame:
    """The ad stream from Kafka topics, comma-separated."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topics).load()
    return parse_ad_log(raw.select(F.col("value").cast("string").alias("value")))


def read_ad_stream_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The ad stream from text files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_ad_log(reader.load(path))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """The listed users as of now."""
    return spark.read.schema("user_id long").parquet(path)
