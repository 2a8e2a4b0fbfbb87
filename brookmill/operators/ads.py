"""Ad-click statistics over a batch of clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DATE


def with_date(clicks: DataFrame) -> DataFrame:
    return clicks.withColumn("date", F.date_format("ts", DATE))


def user_ad_click_counts(clicks: DataFrame) -> DataFrame:
    return with_date(clicks).groupBy("date", "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def blacklist_users(counts: DataFrame, threshold: int = 100) -> DataFrame:
    """Users with any (date, ad) count of the threshold or more."""
    return counts.where(F.col("click_count") >= threshold).select("user_id").distinct()


def filter_blacklist(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users that aren't listed; a null user isn't."""
    return clicks.join(blacklist.select("user_id"), "user_id", "left_anti")


def apply_dynamic_blacklist(clicks: DataFrame, threshold: int = 100, tie: str = "event_id") -> DataFrame:
    """Clicks without those that follow their user's first crossing of the threshold.

    The crossing click itself stays: it counts before its user is listed.
    """
    order = Window.partitionBy("date", "user_id", "ad_id").orderBy("ts", tie)
    counted = with_date(clicks).select("date", "user_id", "ad_id", "ts", tie).withColumn("n", F.row_number().over(order))
    crossed = counted.where(F.col("n") == threshold).groupBy("user_id").agg(F.min(F.struct("ts", tie)).alias("crossed"))
    kept = clicks.join(crossed, "user_id", "left").where(F.col("crossed").isNull() | (F.struct("ts", tie) <= F.col("crossed")))
    return kept.select(*clicks.columns)


def ad_stat(clicks: DataFrame) -> DataFrame:
    return with_date(clicks).groupBy("date", "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_ad_counts(stat: DataFrame) -> DataFrame:
    return stat.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top3(counts: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("date", "province", "ad_id", "click_count")


def trend_columns(windowed: DataFrame) -> DataFrame:
    start = F.col("window.start")
    return windowed.select(F.date_format(start, DATE).alias("date"), F.date_format(start, "HH").alias("hour"), F.date_format(start, "mm").alias("minute"), "ad_id", "click_count")


def ad_click_trend(clicks: DataFrame) -> DataFrame:
    """Clicks of each minute and ad."""
    return trend_columns(clicks.groupBy(F.window("ts", "1 minute"), "ad_id").agg(F.count("*").alias("click_count")))


def trend_last_hour(trend: DataFrame, as_of: str) -> DataFrame:
    """Minutes of the hour before ``as_of`` (``yyyy-MM-dd HH:mm``), its own minute included."""
    minute = F.to_timestamp(F.concat_ws(" ", "date", F.concat_ws(":", "hour", "minute")), "yyyy-MM-dd HH:mm")
    end = F.to_timestamp(F.lit(as_of), "yyyy-MM-dd HH:mm")
    return trend.where((minute > end - F.expr("INTERVAL 60 MINUTES")) & (minute <= end))


def sliding_click_runs(clicks: DataFrame, length: int = 3600, slide: int = 10) -> DataFrame:
    """Clicks of each ad in sliding windows of ``length`` seconds every ``slide`` seconds, as runs.

    A row (ad_id, first_start, last_start, click_count) says that all windows that begin at
    first_start, first_start + slide, ... last_start hold so many clicks; windows without clicks
    are in none.  A click is counted once in its pane of ``slide`` seconds, not once in each of its
    length / slide windows: a pane's count enters with the first window that reaches it and
    leaves after the last, and running sums over these two steps a pane give the windows.
    After the panes an ad has at most two rows for every ``slide`` seconds of the time covered.
    """
    if length % slide:
        raise ValueError("the length has to be a multiple of the slide")
    pane = F.floor(F.unix_timestamp("ts") / slide) * slide
    panes = clicks.where("ts is not null").groupBy("ad_id", pane.cast("bigint").alias("pane")).agg(F.count("*").alias("n"))
    enters, leaves = F.struct((F.col("pane") - length + slide).alias("at"), F.col("n").alias("n")), F.struct((F.col("pane") + slide).alias("at"), (-F.col("n")).alias("n"))
    steps = panes.select("ad_id", F.explode(F.array(enters, leaves)).alias("s")).groupBy("ad_id", F.col("s.at").alias("at")).agg(F.sum("s.n").alias("n"))
    order = Window.partitionBy("ad_id").orderBy("at")
    runs = steps.where("n <> 0").select("ad_id", F.col("at").alias("first_start"), (F.lead("at").over(order) - slide).alias("last_start"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("click_count"))
    return runs.where("click_count > 0")


def _start_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def sliding_ad_clicks_by_pane(clicks: DataFrame, length: int = 3600, slide: int = 10) -> DataFrame:
    """One row for each window with clicks: window_start, ad_id, click_count."""
    runs = sliding_click_runs(clicks, length, slide)
    starts = runs.select(F.explode(F.sequence("first_start", "last_start", F.lit(slide).cast("bigint"))).alias("start"), "ad_id", "click_count")
    return starts.select(_start_text(F.col("start")).alias("window_start"), "ad_id", "click_count")


def busiest_windows(clicks: DataFrame, length: int = 3600, slide: int = 10) -> DataFrame:
    """The sliding window with most clicks of each ad, the earliest of equals, and how many windows have clicks."""
    runs = sliding_click_runs(clicks, length, slide)
    best = F.min_by(F.col("first_start"), F.struct(-F.col("click_count"), F.col("first_start")))
    windows = F.sum((F.col("last_start") - F.col("first_start")) / slide + 1).cast("bigint")
    return runs.groupBy("ad_id").agg(_start_text(best).alias("window_start"), F.max("click_count").alias("click_count"), windows.alias("windows"))


def sliding_ad_clicks(clicks: DataFrame, length: str = "60 minutes", slide: str = "10 minutes") -> DataFrame:
    """Clicks of each ad in sliding windows."""
    counts = clicks.groupBy(F.window("ts", length, slide), "ad_id").agg(F.count("*").alias("click_count"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "ad_id", "click_count")
