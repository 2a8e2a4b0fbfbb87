"""Sinks that merge by key, as joins over whole batches; each returns the table's new content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_overwrite(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``updates`` replace rows of ``current`` with the same keys."""
    return current.join(updates.select(keys), keys, "left_anti").unionByName(updates)


def upsert_add(current: DataFrame, updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of ``updates`` are added to those of ``current``."""
    both = current.select(*keys, value).unionByName(updates.select(*keys, value))
    return both.groupBy(keys).agg(F.sum(value).alias(value))


def replace_groups(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of every group that ``updates`` names are replaced."""
    return current.join(updates.select(keys).distinct(), keys, "left_anti").unionByName(updates)


def lookup_counts(requests: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The stored value of each requested key, 0 where there is none."""
    return requests.select(keys).join(current.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def new_blacklist_users(candidates: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Distinct users that aren't listed yet."""
    return candidates.select("user_id").distinct().join(blacklist, "user_id", "left_anti")


def write_stream(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Starts a stream: a batch every ``interval`` until it is stopped, or without one all that is there, and the end."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start()
