"""Ad-click statistics on a stream: running counts, minute trend, dynamic blacklist, province tops.

What outlives a batch is kept in tables that change epoch by epoch (``EpochTable``): an epoch
writes the dates that it touches, and gives the same tables when it runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ads import blacklist_users, filter_blacklist, province_ad_counts, province_top3, trend_columns, user_ad_click_counts, with_date
from ..schemas import DATE
from ..sources.merge import new_blacklist_users, replace_groups, upsert_add, upsert_overwrite, write_stream
from ..sources.tables import EpochTable, Folder

AD_STAT = "date string, province string, city string, ad_id long, click_count long"
AD_TREND = "date string, hour string, minute string, ad_id long, click_count long"
USER_AD = "date string, user_id long, ad_id long, click_count long"
PROVINCE_TOP = "date string, province string, ad_id long, click_count long"
LISTED = "user_id long"
CLICK = "ts timestamp, province string, city string, user_id long, ad_id long"

STAT_KEYS = ["date", "province", "city", "ad_id"]
USER_KEYS = ["date", "user_id", "ad_id"]


def ad_stat_stream(clicks: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Running counts of (date, province, city, ad); a day's state goes when the watermark passes it."""
    counts = clicks.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), F.date_format("ts", DATE).alias("date"), "province", "city", "ad_id")
    return counts.agg(F.count("*").alias("click_count")).drop("window")


def ad_click_trend_stream(clicks: DataFrame, watermark: str = "60 minutes") -> DataFrame:
    """Clicks of each minute and ad; rows older than the watermark are dropped."""
    return trend_columns(clicks.withWatermark("ts", watermark).groupBy(F.window("ts", "1 minute"), "ad_id").agg(F.count("*").alias("click_count")))


def keep_latest(updates: DataFrame, table: EpochTable, keys: list[str], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Merges a stream of updated rows into a table."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        table.merge(rows, epoch, lambda current, new: upsert_overwrite(current, new, keys))
        rows.unpersist()

    return write_stream(updates, batch, checkpoint, "update", interval)


def update_blacklist(batch: DataFrame, counts: DataFrame, blacklist: DataFrame, threshold: int = 100) -> tuple[DataFrame, DataFrame]:
    """(counts, blacklist) after a batch that has been filtered with the list as it was before."""
    counts = upsert_add(counts, user_ad_click_counts(batch), USER_KEYS, "click_count")
    return counts, blacklist.unionByName(new_blacklist_users(blacklist_users(counts, threshold), blacklist))


def count_users(passed: DataFrame, counts: EpochTable, listed: EpochTable, epoch: int, threshold: int) -> None:
    """Adds a filtered batch to the click counts, and users that reach the threshold to the list.

    Only counts of the batch's dates can have grown, so only these are looked at.
    """
    new = user_ad_click_counts(passed).persist()
    names = counts.merge(new, epoch, lambda current, more: upsert_add(current, more, USER_KEYS, "click_count"))
    over = blacklist_users(counts.read(epoch, names), threshold)
    listed.append(new_blacklist_users(over, listed.read(epoch - 1)), epoch)
    new.unpersist()


def refresh_tops(rows: DataFrame, names: list[str], stat: EpochTable, tops: EpochTable, epoch: int, n: int) -> None:
    """Ranks the dates and provinces of ``rows``, which lie in the partitions ``names``, anew."""
    pairs = rows.select("date", "province").distinct()
    now = stat.read(epoch, names).join(pairs, ["date", "province"], "left_semi")
    best = province_top3(province_ad_counts(now), n).persist()
    tops.merge(best, epoch, lambda current, new: replace_groups(current, new, ["date", "province"]))
    best.unpersist()


def blacklist_stream(clicks: DataFrame, counts: EpochTable, blacklist: EpochTable, checkpoint: str, threshold: int = 100) -> StreamingQuery:
    """Keeps click counts and the blacklist; a listed user's later clicks are not counted."""

    def batch(rows: DataFrame, epoch: int) -> None:
        count_users(filter_blacklist(rows, blacklist.read(epoch - 1)), counts, blacklist, epoch, threshold)

    return write_stream(clicks, batch, checkpoint)


def province_top3_stream(updates: DataFrame, stat: EpochTable, tops: EpochTable, checkpoint: str, n: int = 3, interval: str | None = None) -> StreamingQuery:
    """Merges updated counts and refreshes the tops of the dates and provinces that they touch."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        names = stat.merge(rows, epoch, lambda current, new: upsert_overwrite(current, new, STAT_KEYS))
        refresh_tops(rows, names, stat, tops, epoch, n)
        rows.unpersist()

    return write_stream(updates, batch, checkpoint, "update", interval)


def job_tables(spark: SparkSession, folder: str) -> dict[str, EpochTable]:
    """The tables of the real-time job: user_counts, listed, stat, tops."""
    schemas = {"user_counts": USER_AD, "listed": LISTED, "stat": AD_STAT, "tops": PROVINCE_TOP}
    return {name: EpochTable(spark, f"{folder}/{name}", schema, None if name == "listed" else "date") for name, schema in schemas.items()}


def ad_job_stream(clicks: DataFrame, folder: str, threshold: int = 100, n: int = 3, interval: str | None = None) -> tuple[StreamingQuery, dict[str, EpochTable]]:
    """The real-time job in one query: clicks of listed users go, the others are counted for the list,
    for the running (date, province, city, ad) counts and for the province tops, all in one batch.

    The minute trend reads all clicks and is a stream of its own.  A restart with the same
    folder goes on after the last whole epoch.  Counts are kept in tables only; the chain of
    ``filtered_clicks_stream`` and ``filtered_stat_stream`` keeps them as state that expires.
    """
    tables = job_tables(clicks.sparkSession, folder)

    def batch(rows: DataFrame, epoch: int) -> None:
        passed = filter_blacklist(rows, tables["listed"].read(epoch - 1)).persist()
        count_users(passed, tables["user_counts"], tables["listed"], epoch, threshold)
        new = with_date(passed).groupBy(STAT_KEYS).agg(F.count("*").alias("click_count")).persist()
        names = tables["stat"].merge(new, epoch, lambda current, more: upsert_add(current, more, STAT_KEYS, "click_count"))
        refresh_tops(new, names, tables["stat"], tables["tops"], epoch, n)
        new.unpersist()
        passed.unpersist()

    return write_stream(clicks, batch, f"{folder}/checkpoint", interval=interval), tables


# --- the job as two chained queries -----------------------------------------------------------


def split_late(rows: DataFrame, watermark: object | None, window: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows): late ones lie in a window of so many seconds that ends at or before the watermark.

    A row without a time has no window that it could be counted in, so it goes with the late ones.
    """
    end = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / window) * window + window)
    on_time = F.col("ts").isNotNull() if watermark is None else F.coalesce(end > F.lit(watermark), F.lit(False))
    return rows.where(on_time), rows.where(~on_time)


def chain_tables(spark: SparkSession, folder: str) -> dict[str, EpochTable]:
    """The tables of the first query of the chain: user_counts, listed, late (rows), latest (one time)."""
    return {
        "user_counts": EpochTable(spark, f"{folder}/user_counts", USER_AD), "listed": EpochTable(spark, f"{folder}/listed", LISTED, None),
        "late": EpochTable(spark, f"{folder}/late", f"{CLICK}, date string"), "latest": EpochTable(spark, f"{folder}/latest", "ts timestamp", None),
    }


def filtered_clicks_stream(clicks: DataFrame, folder: str, threshold: int = 100, delay: str = "1 day", interval: str | None = None) -> StreamingQuery:
    """First query of the chain: writes each batch's clicks on time and of users not listed to
    ``filtered/epoch=N``, and keeps the counts, the list and the late clicks.

    A batch is late by the greatest time of the batches before it, less ``delay``.  Its folder
    is moved into place when all its tables are written; the move ends the epoch, and an epoch
    whose folder is there is not run again, so the second query never meets a click twice.
    The store has to move a folder in one step, as HDFS and local disks do.
    """
    spark = clicks.sparkSession
    tables, files = chain_tables(spark, folder), Folder(spark, folder)
    files.make("filtered")

    def batch(rows: DataFrame, epoch: int) -> None:
        if files.exists(f"filtered/epoch={epoch}"):
            return
        rows = rows.persist()
        watermark = tables["latest"].read(epoch - 1).agg(F.max("ts") - F.expr(f"INTERVAL {delay}")).first()[0]
        on_time, late = split_late(rows, watermark)
        passed = filter_blacklist(on_time, tables["listed"].read(epoch - 1)).persist()
        count_users(passed, tables["user_counts"], tables["listed"], epoch, threshold)
        tables["late"].append(with_date(late), epoch)
        tables["latest"].merge(rows.agg(F.max("ts").alias("ts")), epoch, lambda current, new: current.union(new).agg(F.max("ts").alias("ts")))
        passed.select(*(c.split()[0] for c in CLICK.split(", "))).write.mode("overwrite").parquet(f"{folder}/staged/epoch={epoch}")
        files.rename(f"staged/epoch={epoch}", f"filtered/epoch={epoch}")
        passed.unpersist()
        rows.unpersist()

    return write_stream(clicks, batch, f"{folder}/checkpoint-filter", interval=interval)


def filtered_clicks(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The clicks that the first query let pass, as a stream."""
    reader = spark.readStream.schema(f"{CLICK}, epoch int")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/filtered").drop("epoch")


def filtered_stat_stream(spark: SparkSession, folder: str, watermark: str = "1 day", n: int = 3, files_per_batch: int | None = None, interval: str | None = None) -> tuple[StreamingQuery, dict[str, EpochTable]]:
    """Second query of the chain: running counts of the filtered clicks as state with a watermark, a day's
    state going when it has passed, merged into ``stat``; and the tops of what changed.

    The first query's watermark is never behind this one's, so no click is dropped here.
    """
    tables = {"stat": EpochTable(spark, f"{folder}/stat", AD_STAT), "tops": EpochTable(spark, f"{folder}/tops", PROVINCE_TOP)}
    counts = ad_stat_stream(filtered_clicks(spark, folder, files_per_batch), watermark)
    return province_top3_stream(counts, tables["stat"], tables["tops"], f"{folder}/checkpoint-stat", n, interval), tables


def start_realtime_job(clicks: DataFrame, folder: str, threshold: int = 100, n: int = 3, interval: str = "5 seconds") -> tuple[list[StreamingQuery], dict[str, EpochTable]]:
    """Everything that the real-time job keeps, as three queries that run until they are stopped: the
    filter, the state of what it lets pass, and the minute trend of all clicks.

    All tables by name: user_counts, listed, late, latest, stat, tops, trend.
    """
    spark = clicks.sparkSession
    trend = EpochTable(spark, f"{folder}/trend", AD_TREND)
    first = filtered_clicks_stream(clicks, folder, threshold, interval=interval)
    second, tables = filtered_stat_stream(spark, folder, n=n, interval=interval)
    third = keep_latest(ad_click_trend_stream(clicks), trend, ["date", "hour", "minute", "ad_id"], f"{folder}/checkpoint-trend", interval)
    return [first, second, third], chain_tables(spark, folder) | tables | {"trend": trend}


def late_counts(late: DataFrame) -> DataFrame:
    """How many clicks of each day came too late."""
    return late.groupBy("date").agg(F.count("*").alias("late_count"))
