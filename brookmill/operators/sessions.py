"""Session analysis: aggregates, user join, filters, length and step distributions, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import STEP_BUCKETS, VISIT_BUCKETS, parse_time, step_length_bucket, visit_length_bucket
from ..functions.filters import between_or_pass, equal_or_pass, in_or_pass, overlap_or_pass
from ..params import TaskParams
from ..schemas import TIME

DETAIL_COLUMNS = (
    "user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id",
    "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids",
)


def aggregate_sessions(actions: DataFrame) -> DataFrame:
    """One row a session: user, distinct keywords and clicked categories, start, length, steps.

    Only partial aggregates are shuffled, so a session with very many actions is no burden.
    """
    when = parse_time(F.col("action_time"))
    keyword = F.when(F.col("search_keyword") != "", F.col("search_keyword"))
    rows = actions.where("session_id is not null").groupBy("session_id")
    found = rows.agg(
        F.min("user_id").alias("user_id"), F.array_sort(F.collect_set(keyword)).alias("search_keywords"), F.array_sort(F.collect_set("click_category_id")).alias("click_category_ids"),
        F.min(when).alias("start"), F.max(when).alias("end"), F.count("*").alias("step_length"),
    )
    seconds = F.coalesce(F.unix_timestamp("end") - F.unix_timestamp("start"), F.lit(0))
    return found.select("session_id", "user_id", "search_keywords", "click_category_ids", F.date_format("start", TIME).alias("start_time"), seconds.alias("visit_length"), "step_length")


def join_user(sessions: DataFrame, users: DataFrame, broadcast: bool = False) -> DataFrame:
    """Adds age, professional, city and sex; sessions of unknown users go.

    ``broadcast`` is for a caller who knows that the user table is small; otherwise Spark
    decides by its measured size and splits hot users.
    """
    wanted = users.select("user_id", "age", "professional", "city", "sex")
    return sessions.join(F.broadcast(wanted) if broadcast else wanted, "user_id")


def filter_sessions(sessions: DataFrame, p: TaskParams) -> DataFrame:
    """Sessions that pass every given parameter."""
    tests = [
        between_or_pass(F.col("age"), p.start_age, p.end_age), in_or_pass(F.col("professional"), p.professionals), in_or_pass(F.col("city"), p.cities),
        equal_or_pass(F.col("sex"), p.sex), overlap_or_pass(F.col("search_keywords"), p.keywords), overlap_or_pass(F.col("click_category_ids"), p.category_ids, "bigint"),
    ]
    return sessions.where(reduce(lambda a, b: a & b, tests))


def session_detail(actions: DataFrame, sessions: DataFrame, dedupe: bool = True) -> DataFrame:
    """Actions of the given sessions; once each, or once for every row of ``sessions``."""
    return actions.join(sessions.select("session_id"), "session_id", "left_semi" if dedupe else "inner")


def to_session_detail(actions: DataFrame, task_id: int) -> DataFrame:
    return actions.select(F.lit(task_id).cast("bigint").alias("task_id"), *DETAIL_COLUMNS)


def session_bucket_counts(sessions: DataFrame) -> DataFrame:
    """One row: how many sessions there are, and how many in each bucket."""
    visit, step = visit_length_bucket(F.col("visit_length")), step_length_bucket(F.col("step_length"))
    counts = [F.count_if(visit == n).alias(f"visit_{n}") for n, *_ in VISIT_BUCKETS] + [F.count_if(step == n).alias(f"step_{n}") for n, *_ in STEP_BUCKETS]
    return sessions.agg(F.count("*").alias("session_count"), *counts)


def session_aggr_stat(sessions: DataFrame, task_id: int) -> DataFrame:
    """Shares of all sessions by bucket, to two digits; null where there is no session."""
    counts = session_bucket_counts(sessions)
    total = F.nullif(F.col("session_count"), F.lit(0))
    shares = [F.round(F.col(c) / total, 2).alias(f"{c}_ratio") for c in counts.columns[1:]]
    return counts.select(F.lit(task_id).cast("bigint").alias("task_id"), "session_count", *shares)


def sessions_per_hour(sessions: DataFrame) -> DataFrame:
    start = F.col("start_time")
    return sessions.groupBy(F.substring(start, 1, 10).alias("date"), F.substring(start, 12, 2).alias("hour")).agg(F.count("*").alias("session_count"))


def extract_quota(hour_counts: DataFrame, total: int = 100) -> DataFrame:
    """How many sessions to draw in each hour: the days share ``total`` evenly, the hours of a
    day by their sessions; parts are dropped."""
    days = F.count("*").over(Window.partitionBy())
    per_day = hour_counts.groupBy("date").agg(F.sum("session_count").alias("day_count"))
    per_day = per_day.select("date", "day_count", F.floor(F.lit(total) / days).alias("per_day"))  # one row a day
    quota = F.floor(F.col("session_count") / F.col("day_count") * F.col("per_day"))
    return hour_counts.join(per_day, "date").select("date", "hour", "session_count", F.least(quota, "session_count").cast("bigint").alias("quota"))


def random_extract_sessions(sessions: DataFrame, total: int = 100, seed: str = "0") -> DataFrame:
    """Draws each hour's quota of sessions without replacement, in the order of a seeded digest.

    Only ids are ranked.  No quota exceeds ``total``, which lets Spark cut each hour's
    sessions down to that many before they are shuffled.
    """
    quota = extract_quota(sessions_per_hour(sessions), total)
    ids = sessions.select("session_id", F.substring("start_time", 1, 10).alias("date"), F.substring("start_time", 12, 2).alias("hour"), F.md5(F.concat("session_id", F.lit(seed)).cast("binary")).alias("digest"))
    ids = ids.join(quota, ["date", "hour"])
    rank = F.row_number().over(Window.partitionBy("date", "hour").orderBy("digest", "session_id"))
    drawn = ids.withColumn("draw", rank).where((F.col("draw") <= total) & (F.col("draw") <= F.col("quota"))).select("session_id")
    return sessions.join(drawn, "session_id", "left_semi").select("session_id", "start_time", F.array_join("search_keywords", ",").alias("search_keywords"), F.array_join(F.col("click_category_ids").cast("array<string>"), ",").alias("click_category_ids"))
