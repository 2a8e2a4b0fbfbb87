"""The registered shop queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions import columns as C
from .operators import ads, categories, pages, products, sessions, skew
from .params import TaskParams
from .sources import adapters, merge
from .sources.readers import actions_by_date, click_actions_by_date
from .sources.scratch import new_folder
from .sources.tables import EpochTable, Folder
from .streaming import ads as stream

START, END = "2024-01-05", "2024-01-25"
PARAMS = TaskParams(START, END, 20, 50, None, None, "male", tuple(f"kw{i}" for i in range(1, 8)), None, (3, 5, 2, 8))
#: For the sampling: three days.
DRAW = ("2024-01-05", "2024-01-07")
THRESHOLD = 3
AS_OF = "2024-01-15 12:00"
SPLIT = "2024-01-15"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _actions(s, d, dates=(START, END)):
    return actions_by_date(adapters.user_visit_action(s, d, dates), *dates)


def _sessions(s, d):
    return sessions.aggregate_sessions(_actions(s, d))


def _passing(s, d):
    return sessions.filter_sessions(sessions.join_user(_sessions(s, d), adapters.user_info(s, d)), PARAMS)


def _details(s, d):
    """Actions of the sessions of men; enough for every category to occur."""
    men = sessions.filter_sessions(sessions.join_user(_sessions(s, d), adapters.user_info(s, d)), TaskParams(sex="male"))
    return sessions.session_detail(_actions(s, d), men)


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumns({"search_keywords": F.array_join("search_keywords", ","), "click_category_ids": F.array_join(F.col("click_category_ids").cast("array<string>"), ",")})


@query
def area_top3_product(s, d):
    basic = products.click_product_basic(adapters.purchases_as_clicks(s, d), adapters.city_info(s, d))
    return products.area_top3_product(products.area_full_product(products.area_product_click_count(basic), adapters.product_info(s, d)))


@query
def q_actions_by_date(s, d):
    return _actions(s, d)


@query
def q_click_actions_by_date(s, d):
    return click_actions_by_date(adapters.user_visit_action(s, d, (START, END)), START, END)


@query
def session_aggregate(s, d):
    return _texts(_sessions(s, d))


@query
def session_full_aggregate(s, d):
    return _texts(sessions.join_user(_sessions(s, d), adapters.user_info(s, d)))


@query
def session_filter(s, d):
    return _texts(_passing(s, d))


@query
def session_detail(s, d):
    return sessions.to_session_detail(sessions.session_detail(_actions(s, d), _passing(s, d)), 1)


@query
def session_bucket_counts(s, d):
    return sessions.session_bucket_counts(_sessions(s, d))


@query
def session_aggr_stat(s, d):
    return sessions.session_aggr_stat(_sessions(s, d), 1)


@query
def sessions_per_hour(s, d):
    return sessions.sessions_per_hour(_sessions(s, d))


def _drawn_from(s, d):
    return sessions.aggregate_sessions(_actions(s, d, DRAW))


@query
def extract_quota(s, d):
    return sessions.extract_quota(sessions.sessions_per_hour(_drawn_from(s, d)))


@query
def random_extract_sessions(s, d):
    return sessions.random_extract_sessions(_drawn_from(s, d), seed="7")


@query
def random_extract_detail(s, d):
    drawn = sessions.random_extract_sessions(_drawn_from(s, d), seed="7")
    return sessions.to_session_detail(sessions.session_detail(_actions(s, d, DRAW), drawn), 1)


for _name in ("category_universe", "click_category_counts", "order_category_counts", "pay_category_counts", "category_counts", "top10_category"):
    QUERIES[_name] = lambda s, d, f=getattr(categories, _name): f(_details(s, d))


@query
def top10_session(s, d):
    details = _details(s, d)
    return categories.top10_session(details, categories.top10_category(details))


@query
def top10_session_detail(s, d):
    """Repeats a session's actions for each category it ranks in."""
    details = _details(s, d)
    best = categories.top10_session(details, categories.top10_category(details))
    return sessions.to_session_detail(sessions.session_detail(details, best, dedupe=False), 1)


@query
def page_splits(s, d):
    return pages.page_splits(adapters.user_visit_action(s, d))


@query
def ranged_page_splits(s, d):
    return pages.ranged_page_splits(adapters.user_visit_action(s, d))


@query
def page_split_pv(s, d):
    return pages.page_split_pv(adapters.user_visit_action(s, d), PARAMS.page_flow)


@query
def start_page_pv(s, d):
    return pages.start_page_pv(adapters.user_visit_action(s, d), PARAMS.page_flow)


@query
def page_convert_rate(s, d):
    return pages.page_convert_rate(adapters.user_visit_action(s, d), PARAMS.page_flow)


@query
def page_convert_text(s, d):
    return pages.format_convert_rate(pages.page_convert_rate(adapters.user_visit_action(s, d), PARAMS.page_flow))


def _basic(s, d):
    return products.click_product_basic(click_actions_by_date(adapters.user_visit_action(s, d, (START, END)), START, END), adapters.city_info(s, d))


@query
def click_product_basic(s, d):
    return _basic(s, d)


@query
def area_product_click_count(s, d):
    return products.area_product_click_count(_basic(s, d))


@query
def area_full_product(s, d):
    return products.area_full_product(products.area_product_click_count(_basic(s, d)), adapters.product_info(s, d))


@query
def user_ad_click_counts(s, d):
    return ads.user_ad_click_counts(adapters.ad_clicks(s, d))


@query
def blacklist_users(s, d):
    return ads.blacklist_users(ads.user_ad_click_counts(adapters.ad_clicks(s, d)), THRESHOLD)


def _click_rows(df: DataFrame) -> DataFrame:
    return df.select("event_id", "province", "city", "user_id", "ad_id")


@query
def filter_blacklist(s, d):
    return _click_rows(ads.filter_blacklist(adapters.ad_clicks(s, d), blacklist_users(s, d)))


@query
def apply_dynamic_blacklist(s, d):
    return _click_rows(ads.apply_dynamic_blacklist(adapters.ad_clicks(s, d), THRESHOLD))


@query
def ad_stat(s, d):
    return ads.ad_stat(adapters.ad_clicks(s, d))


@query
def province_ad_counts(s, d):
    return ads.province_ad_counts(ads.ad_stat(adapters.ad_clicks(s, d)))


@query
def province_top3(s, d):
    return ads.province_top3(province_ad_counts(s, d))


@query
def ad_click_trend(s, d):
    return ads.ad_click_trend(adapters.ad_clicks(s, d))


@query
def trend_last_hour(s, d):
    return ads.trend_last_hour(ads.ad_click_trend(adapters.ad_clicks(s, d)), AS_OF)


@query
def sliding_ad_clicks(s, d):
    return ads.sliding_ad_clicks(adapters.ad_clicks(s, d))


@query
def busiest_windows(s, d):
    """An hour every ten seconds."""
    return ads.busiest_windows(adapters.ad_clicks(s, d), 3600, 10)


@query
def sliding_ad_clicks_by_pane(s, d):
    """The windows of ``sliding_ad_clicks``, from panes."""
    return ads.sliding_ad_clicks_by_pane(adapters.ad_clicks(s, d), 3600, 600).withColumn("window_start", F.substring("window_start", 1, 16))


def _halves(s, d):
    """Counts by (date, province, city, ad) up to the split date, and from two days before it on."""
    stat = ads.ad_stat(adapters.ad_clicks(s, d))
    return stat.where(F.col("date") <= SPLIT), stat.where(F.col("date") >= F.lit("2024-01-13")).withColumn("click_count", F.col("click_count") + 10)


STAT_KEYS = ["date", "province", "city", "ad_id"]


@query
def upsert_overwrite(s, d):
    return merge.upsert_overwrite(*_halves(s, d), STAT_KEYS)


@query
def upsert_add(s, d):
    return merge.upsert_add(*_halves(s, d), STAT_KEYS, "click_count")


@query
def replace_groups(s, d):
    current, updates = _halves(s, d)
    return merge.replace_groups(current, updates.where("ad_id < 3"), ["date", "province"])


@query
def lookup_counts(s, d):
    current, updates = _halves(s, d)
    return merge.lookup_counts(updates, current, STAT_KEYS, "click_count")


@query
def new_blacklist_users(s, d):
    return merge.new_blacklist_users(adapters.ad_clicks(s, d), blacklist_users(s, d))


@query
def salted_count(s, d):
    return skew.salted_count(adapters.purchases_as_clicks(s, d).select("city_id", "product_id"), ["city_id"])


def _joined(df: DataFrame) -> DataFrame:
    return df.groupBy("city_id", "city_name", "area").agg(F.count("*").alias("row_count"), F.sum("product_id").alias("product_sum"))


@query
def salted_join(s, d):
    return _joined(skew.salted_join(adapters.purchases_as_clicks(s, d).select("city_id", "product_id"), adapters.city_info(s, d), "city_id"))


@query
def skew_isolated_join(s, d):
    return _joined(skew.skew_isolated_join(adapters.purchases_as_clicks(s, d).select("city_id", "product_id"), adapters.city_info(s, d), "city_id", salt=10))


@query
def weighted_skew_join(s, d):
    return _joined(skew.weighted_skew_join(adapters.purchases_as_clicks(s, d).select("city_id", "product_id"), adapters.city_info(s, d), "city_id", tasks=40))


def _buyer_cities(s, d):
    """(product_id, city) of all order lines."""
    cities = adapters.city_info(s, d).select("city_id", C.concat_long_string(F.col("city_id"), ":", F.col("city_name")).alias("city"))
    return adapters.purchases_as_clicks(s, d).join(cities, "city_id").select("product_id", "city")


@query
def salted_group_concat(s, d):
    return skew.salted_group_concat(_buyer_cities(s, d), ["product_id"], "city", "city_infos")


@query
def salted_distinct(s, d):
    """The products bought in each city; every city is a hot key."""
    found = skew.salted_distinct(adapters.purchases_as_clicks(s, d), ["city_id"], "product_id")
    return found.select("city_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("product_ids"), F.col("n_values").alias("n_products"))


@query
def date_functions(s, d):
    a = adapters.user_visit_action(s, d).select("event_id", F.col("action_time").alias("t"), F.concat("date", F.lit(" 12:00:00")).alias("noon"))
    t, noon, ts = F.col("t"), F.col("noon"), C.parse_time(F.col("t"))
    return a.select(
        "event_id", C.before(t, noon).alias("is_before"), C.after(t, noon).alias("is_after"), C.minus_seconds(t, noon).alias("seconds"), C.minus_seconds(F.lit("bad"), noon).alias("unreadable"),
        C.date_hour(t).alias("date_hour"), C.format_date(ts).alias("date_text"), C.format_time(ts).alias("time_text"), C.format_date_key(ts).alias("date_key"), C.format_minute_key(ts).alias("minute_key"),
        C.format_date(C.parse_date_key(C.format_date_key(ts))).alias("key_back"),
    )


@query
def string_functions(s, d):
    a = adapters.user_visit_action(s, d)
    k = F.col("page_id").cast("string")
    return a.select(
        "event_id", C.is_empty(F.col("search_keyword")).alias("no_keyword"), C.trim_comma(F.concat(F.lit(","), k, F.lit(","))).alias("trimmed"), C.pad_two(k).alias("padded"),
        C.concat_long_string(F.col("city_id"), ":", F.col("search_keyword")).alias("joined"), F.array_join(C.csv_to_longs(F.col("order_product_ids")).cast("array<string>"), ";").alias("longs"),
        C.round_half_up(F.col("event_id") / 8, 2).alias("rounded"),
    )


@query
def json_functions(s, d):
    info = adapters.product_info(s, d)
    listed = F.concat(F.lit("["), F.col("extend_info"), F.lit(', {"product_status": 9}]'))
    return info.select("product_id", C.json_field(F.col("extend_info"), "product_status").alias("status"), C.json_field(F.col("product_name"), "product_status").alias("bad"), C.first_json_field(listed, "product_status").alias("first"), C.product_status(F.col("extend_info")).alias("label"))


@query
def concat_field_functions(s, d):
    a = adapters.user_visit_action(s, d)
    text = F.concat(F.lit("page="), F.col("page_id").cast("string"), F.lit("|kw="), F.coalesce("search_keyword", F.lit("")), F.lit("|city="), F.col("city_id").cast("string"))
    return a.select("event_id", C.get_field(text, "page").alias("page"), C.get_field(text, "kw").alias("kw"), C.get_field(text, "city").alias("city"), C.get_field(text, "ity").alias("none"), C.set_field(text, "kw", "new").alias("changed"), C.set_field(text, "zz", "new").alias("same"))


@query
def prefix_roundtrip(s, d):
    named = adapters.user_info(s, d).select("user_id", F.concat(F.col("name"), F.lit("_"), F.col("city")).alias("v"))
    salted = C.add_prefix(F.col("v"), 10, F.col("user_id"))
    return named.select("user_id", "v", C.remove_prefix(salted).alias("back"), F.length(salted).alias("salted_length"))


@query
def case_when_if(s, d):
    """Grades by ranges of the customer's age, and a two-way choice."""
    age = F.col("age")
    grade = F.when(age >= 60, "A").when(age >= 45, "B").when(age >= 30, "C").otherwise("D")
    return adapters.user_info(s, d).select("user_id", "age", grade.alias("grade"), F.when(age >= 45, "GOOD").otherwise("BAD").alias("judged"))


@query
def row_number_demo(s, d):
    order = Window.partitionBy("professional").orderBy(F.desc("age"), "user_id")
    return adapters.user_info(s, d).select("professional", "user_id", "age", F.row_number().over(order).alias("rank"))


def _click_stream(s: SparkSession, d: str) -> DataFrame:
    """Ad clicks as a file stream over the events."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    folder, city = d, adapters.city_info(s, d)
    events = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet") if _is_folder(s, d) else s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", (k % 10).alias("ad_id"), (F.col("user_id") % 25).alias("city_id"))
    return rows.join(city, "city_id").select("ts", F.col("area").alias("province"), F.col("city_name").alias("city"), "user_id", "ad_id")


def _is_folder(s: SparkSession, d: str) -> bool:
    """Whether the events are a folder of files; Spark names the files it reads."""
    return any("/events.parquet/" in f for f in s.read.parquet(f"{d}/events.parquet").inputFiles())


def _ended(q) -> None:
    """Waits for a stream that ends by itself."""
    if not q.awaitTermination(600):
        q.stop()
        raise TimeoutError("the stream did not end")


def _last(table: EpochTable, q) -> DataFrame:
    """The table after a stream that ends by itself."""
    _ended(q)
    return table.read()


@query
def ad_stat_stream(s, d):
    folder = new_folder(s, "ad-stat")
    table = EpochTable(s, f"{folder}/table", stream.AD_STAT)
    return _last(table, stream.keep_latest(stream.ad_stat_stream(_click_stream(s, d)), table, STAT_KEYS, f"{folder}/checkpoint"))


@query
def ad_click_trend_stream(s, d):
    folder = new_folder(s, "ad-trend")
    table = EpochTable(s, f"{folder}/table", stream.AD_TREND)
    return _last(table, stream.keep_latest(stream.ad_click_trend_stream(_click_stream(s, d)), table, ["date", "hour", "minute", "ad_id"], f"{folder}/checkpoint"))


@query
def blacklist_stream(s, d):
    folder = new_folder(s, "ad-blacklist")
    counts = EpochTable(s, f"{folder}/counts", stream.USER_AD)
    listed = EpochTable(s, f"{folder}/listed", stream.LISTED, None)
    return _last(listed, stream.blacklist_stream(_click_stream(s, d), counts, listed, f"{folder}/checkpoint", THRESHOLD))


@query
def province_top3_stream(s, d):
    folder = new_folder(s, "ad-tops")
    stat = EpochTable(s, f"{folder}/stat", stream.AD_STAT)
    tops = EpochTable(s, f"{folder}/tops", stream.PROVINCE_TOP)
    return _last(tops, stream.province_top3_stream(stream.ad_stat_stream(_click_stream(s, d)), stat, tops, f"{folder}/checkpoint"))


#: First days of the deliveries of clicks; every LATE_OF-th click of the first comes with the last.
DELIVERIES = ("2024-01-01", "2024-01-11", "2024-01-21")
LATE_OF = 7


def _delivered(s: SparkSession, d: str) -> DataFrame:
    """All ad clicks with the number of their delivery, from 1."""
    number = F.lit(1)
    for i, day in enumerate(DELIVERIES[1:], 2):
        number = F.when(F.col("ts") >= F.lit(day).cast("timestamp"), i).otherwise(number)
    clicks = adapters.ad_clicks(s, d)
    late = (number == 1) & (F.col("event_id") % LATE_OF == 3)
    return clicks.select("ts", "province", "city", "user_id", "ad_id", F.when(late, len(DELIVERIES)).otherwise(number).alias("delivery"))


def _deliver(s: SparkSession, d: str, folder: str, run) -> None:
    """Puts the deliveries into ``folder``/in one after the other; ``run`` is called after each with the
    stream of clicks, so every delivery is a batch of a job that has been started anew."""
    clicks = _delivered(s, d)
    Folder(s, folder).make("in")
    for i in range(1, len(DELIVERIES) + 1):
        clicks.where(F.col("delivery") == i).drop("delivery").write.parquet(f"{folder}/staged-in/delivery={i}")
        Folder(s, folder).rename(f"staged-in/delivery={i}", f"in/delivery={i}")
        run(s.readStream.schema(f"{stream.CLICK}, delivery int").parquet(f"{folder}/in").drop("delivery"))


@query
def ad_job_stream(s, d):
    """The job in one query over all deliveries; tops of what passed."""
    folder = new_folder(s, "ad-job")
    _deliver(s, d, folder, lambda clicks: _ended(stream.ad_job_stream(clicks, f"{folder}/job", THRESHOLD)[0]))
    return stream.job_tables(s, f"{folder}/job")["tops"].read()


@query
def ad_chain_stream(s, d):
    """The chained queries over all deliveries, both started anew for each: running counts of the
    clicks that passed, kept as state that expires, their tops, the late clicks of each day, and
    the listed users."""
    folder = f'{new_folder(s, "ad-chain")}/job'
    tables = stream.chain_tables(s, folder)

    def run(clicks: DataFrame) -> None:
        _ended(stream.filtered_clicks_stream(clicks, folder, THRESHOLD))
        second, found = stream.filtered_stat_stream(s, folder)
        _ended(second)
        tables.update(found)

    _deliver(s, d, folder.removesuffix("/job"), run)

    def rows(kind: str, df: DataFrame, **columns: Column) -> DataFrame:
        named = {c: F.col(c) if c in df.columns else F.lit(None).cast("bigint" if c == "ad_id" else "string") for c in STAT_KEYS} | columns
        return df.select(F.lit(kind).alias("kind"), *(x.alias(c) for c, x in named.items()), *([] if "click_count" in columns else ["click_count"]))

    return (
        rows("stat", tables["stat"].read()).unionByName(rows("top", tables["tops"].read()))
        .unionByName(rows("late", stream.late_counts(tables["late"].read()), click_count=F.col("late_count")))
        .unionByName(rows("listed", tables["listed"].read(), ad_id=F.col("user_id"), click_count=F.lit(1).cast("bigint")))
    )


QUERIES["actions_by_date"] = QUERIES.pop("q_actions_by_date")
QUERIES["click_actions_by_date"] = QUERIES.pop("q_click_actions_by_date")
