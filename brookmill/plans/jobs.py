"""The four jobs from tables to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import ads, categories, pages, products, sessions
from ..params import TaskParams
from ..sources.database import Database
from ..sources.merge import append
from ..sources.readers import actions_by_date, click_actions_by_date


def session_job(actions: DataFrame, users: DataFrame, p: TaskParams, task_id: int, seed: str = "0") -> dict[str, DataFrame]:
    """Result tables of the session analysis by name.

    The filtered sessions and their actions are kept, since most results start from them;
    call ``unpersist`` on ``sessions`` and ``details`` of the result when done.
    """
    in_range = actions_by_date(actions, p.start_date, p.end_date)
    passing = sessions.filter_sessions(sessions.join_user(sessions.aggregate_sessions(in_range), users), p).persist(StorageLevel.MEMORY_AND_DISK)
    details = sessions.session_detail(in_range, passing).persist(StorageLevel.MEMORY_AND_DISK)
    drawn = sessions.random_extract_sessions(passing, seed=seed)
    top = categories.top10_category(details)
    best = categories.top10_session(details, top)
    task = F.lit(task_id).cast("bigint").alias("task_id")
    return {
        "sessions": passing,
        "details": details,
        "session_aggr_stat": sessions.session_aggr_stat(passing, task_id),
        "session_random_extract": drawn.select(task, "*"),
        "session_detail": sessions.to_session_detail(sessions.session_detail(details, drawn.select("session_id").union(best.select("session_id"))), task_id),
        "top10_category": top.select(task, "*"),
        "top10_session": best.select(task, "*"),
    }


def page_job(actions: DataFrame, p: TaskParams, task_id: int, tie: str = "event_id") -> DataFrame:
    """page_split_convert_rate: one text for the task."""
    rates = pages.page_convert_rate(actions_by_date(actions, p.start_date, p.end_date), p.page_flow, tie)
    return pages.format_convert_rate(rates).select(F.lit(task_id).cast("bigint").alias("task_id"), "convert_rate")


def product_job(actions: DataFrame, cities: DataFrame, product_info: DataFrame, p: TaskParams, task_id: int) -> DataFrame:
    """area_top3_product of the task's dates."""
    basic = products.click_product_basic(click_actions_by_date(actions, p.start_date, p.end_date), cities)
    top = products.area_top3_product(products.area_full_product(products.area_product_click_count(basic), product_info))
    return top.select(F.lit(task_id).cast("bigint").alias("task_id"), "*")


def ad_job(clicks: DataFrame, threshold: int = 100) -> dict[str, DataFrame]:
    """The ad statistics of a batch of clicks; the trend is over unfiltered clicks."""
    kept = ads.apply_dynamic_blacklist(clicks, threshold)
    stat = ads.ad_stat(kept)
    return {
        "ad_user_click_count": ads.user_ad_click_counts(kept),
        "ad_blacklist": ads.blacklist_users(ads.user_ad_click_counts(clicks), threshold),
        "ad_stat": stat,
        "ad_province_top3": ads.province_top3(ads.province_ad_counts(stat)),
        "ad_click_trend": ads.ad_click_trend(clicks),
    }


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Appends each result table to its folder."""
    for name, df in tables.items():
        append(df, f"{folder}/{name}")


def save_to_database(tables: dict[str, DataFrame], database: Database, run: int) -> list[str]:
    """Appends each result table in the database, once for each run number; returns those that were new.

    Run numbers rise: a number at or below a table's last one counts as done.
    """
    return [name for name, df in tables.items() if database.append(df, name, run)]


def session(app: str = "shop", hive: bool = False) -> SparkSession:
    """A session for the jobs, with the Hive catalog if asked for."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()
