"""Operators for hot keys and long sessions equal the plain ones, and their plans spread the work."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brookmill.functions import columns as C
from brookmill.operators import ads, pages, sessions, skew
from brookmill.schemas import USER_VISIT_ACTION
from brookmill.sources import adapters, readers


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


# --- page pairs --------------------------------------------------------------------------


def steps(spark, rows):
    return spark.createDataFrame(rows, "session_id string, page_id long, action_time string, event_id long")


def test_ranged_page_splits_equal_plain_ones(spark):
    """One session holds half of all actions; some sessions and pages are null, times are tied or unreadable."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        session = "hot" if i % 2 else rng.choice([None, *(f"s{j}" for j in range(200))])
        time = rng.choice([f"2024-01-0{rng.randint(1, 9)} {rng.randint(0, 23)}:0{rng.randint(0, 9)}:00", "2024-01-05 5:00:00", "bad"])
        rows.append((session, rng.choice([None, *range(10)]), time, i))
    df = steps(spark, rows).repartition(5)
    for ranges in (1, 7, 40):
        assert rows_of(pages.ranged_page_splits(df, ranges=ranges)) == rows_of(pages.page_splits(df))
    assert pages.ranged_page_splits(df.limit(0)).count() == 0


def test_long_session_is_spread(spark):
    """No range holds the session that has half of all actions."""
    df = steps(spark, [("hot" if i % 2 else f"s{i}", i % 10, f"2024-01-01 {i % 24}:00:00", i) for i in range(20_000)]).repartition(4)
    order = [F.asc_nulls_first("session_id"), F.asc_nulls_first("_time"), F.asc_nulls_first("event_id")]
    timed = df.select("session_id", C.parse_time(F.col("action_time")).alias("_time"), "event_id").repartitionByRange(16, *order)
    sizes = [r[0] for r in timed.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 3 * 20_000 / 16
    assert "rangepartitioning(session_id" in plan_of(pages.ranged_page_splits(df, ranges=16))


# --- hot keys ------------------------------------------------------------------------------


def test_weighted_join_equals_plain_join(spark):
    rng = random.Random(2)
    keys = [1] * 500 + [2] * 300 + [3] * 200 + [rng.randint(4, 60) for _ in range(400)] + [None] * 50
    left = spark.createDataFrame([(k, i, i % 3) for i, k in enumerate(keys)], "k long, v long, salts long").repartition(6)
    right = spark.createDataFrame([(k, f"r{k}") for k in [*range(0, 50), 1, None]], "k long, name string")
    assert rows_of(skew.weighted_skew_join(left, right, "k", tasks=10).select("k", "v", "salts", "name")) == rows_of(left.join(right, "k").select("k", "v", "salts", "name"))
    assert skew.weighted_skew_join(left.limit(0), right, "k", tasks=10).count() == 0


def test_salts_follow_the_weight(spark):
    """Three hot keys: each is cut into as many shares as it holds, and no share is much larger than another."""
    keys = ["a"] * 5000 + ["b"] * 2500 + ["c"] * 1500 + [f"k{i}" for i in range(1000)]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v long").repartition(8)
    heavy = {r["k"]: (r["weight"], r["salts"]) for r in skew.heavy_keys(left, "k", tasks=20).collect()}
    assert heavy == {"a": (5000, 10), "b": (2500, 5), "c": (1500, 3)}
    right = spark.createDataFrame([(k, 1) for k in {*keys}], "k string, w long")
    plan = plan_of(skew.weighted_skew_join(left, right, "k", tasks=20))
    assert "_salt" in plan and "approx_top_k" in plan
    spread = left.withColumn("s", F.pmod(skew._row_hash(left), F.when(F.col("k") == "a", 10).when(F.col("k") == "b", 5).when(F.col("k") == "c", 3).otherwise(1)))
    assert max(r[0] for r in spread.groupBy("k", "s").count().select("count").collect()) < 1.2 * 10_000 / 20


def test_heavy_keys_of_many(spark):
    """Far more keys than counters: none that holds more than a share is missed."""
    df = spark.range(200_000).select(F.when(F.col("id") % 5 == 0, 7).when(F.col("id") % 11 == 0, 8).otherwise(F.col("id")).alias("k"))
    assert {r["k"] for r in skew.heavy_keys(df, "k", tasks=15).collect()} == {7, 8}


def test_salt_is_the_rows_own(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)], "k long, v long")
    salts = lambda df: sorted(tuple(r) for r in df.select("v", skew._salt(df, 7).alias("s")).collect())
    assert salts(left) == salts(left.repartition(5)) and len({s for _, s in salts(left)}) == 7


def test_salted_distinct_lists(spark):
    df = spark.createDataFrame([("hot", str(i % 400)) for i in range(4000)] + [("x", None), ("x", "b"), (None, "c"), ("y", None), ("x", "b")], "k string, v string").repartition(4)
    assert rows_of(skew.salted_group_concat(df, ["k"], "v", "list")) == rows_of(skew.plain_group_concat(df, ["k"], "v", "list"))
    found = {r["k"]: (r["values"], r["n_values"]) for r in skew.salted_distinct(df, ["k"], "v", 8).collect()}
    assert found["y"] == ([], 0) and found["x"] == (["b"], 1) and found["hot"][1] == 400 and found["hot"][0] == sorted(found["hot"][0])
    assert skew.salted_distinct(df.limit(0), ["k"], "v").count() == 0
    # a salt of the hot key holds a small part of its values
    part = df.where("k = 'hot'").select("v", F.pmod(F.xxhash64("v", F.lit(31)), F.lit(8)).alias("s")).groupBy("s").agg(F.count_distinct("v").alias("n"))
    assert max(r["n"] for r in part.collect()) < 100


# --- dynamic blacklist ----------------------------------------------------------------------


def test_blacklist_with_one_hot_user(spark):
    """Half of all clicks are one user's on one ad and day; every input task sends on at most threshold of them."""
    rng = random.Random(3)
    data = [(7 if i % 2 else rng.randint(8, 40), 1 if i % 2 else i % 5, f"2024-01-01 {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00", i) for i in range(4000)]
    clicks = spark.createDataFrame(data, "user_id long, ad_id long, time string, event_id long").select("*", F.to_timestamp("time").alias("ts")).drop("time").repartition(8)
    got = {r["event_id"] for r in ads.apply_dynamic_blacklist(clicks, 20).collect()}
    first = {}
    for user in {d[0] for d in data}:
        for ad in range(5):
            own = sorted((d[2], d[3]) for d in data if d[0] == user and d[1] == ad)
            if len(own) >= 20:
                first[user] = min(first.get(user, own[19]), own[19])
    assert got == {d[3] for d in data if d[0] not in first or (d[2], d[3]) <= first[d[0]]}
    plan = plan_of(ads.apply_dynamic_blacklist(clicks, 20))
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan and "Final" in plan


# --- sliding windows --------------------------------------------------------------------------


@pytest.mark.parametrize("length, slide", [(3600, 600), (60, 10), (10, 10)])
def test_panes_equal_windows(spark, length, slide):
    rng = random.Random(4)
    times = [1704067200 + rng.randint(0, 4000) for _ in range(300)] + [1704067200] * 20 + [1704067200 + 90_000, None]
    clicks = spark.createDataFrame([(t, rng.randint(1, 3)) for t in times], "s long, ad_id long").select(F.timestamp_seconds("s").alias("ts"), "ad_id")
    plain = clicks.groupBy(F.window("ts", f"{length} seconds", f"{slide} seconds"), "ad_id").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss"), "ad_id", "n")
    assert rows_of(ads.sliding_ad_clicks_by_pane(clicks, length, slide)) == rows_of(plain)
    assert ads.sliding_click_runs(clicks, length, slide).count() <= 2 * clicks.count()


def test_panes_of_the_events(spark, sf_dir):
    """An hour every ten seconds over the whole event stream, against the 360 copies of each row."""
    clicks = adapters.ad_clicks(spark, sf_dir)
    plain = clicks.groupBy(F.window("ts", "60 minutes", "10 seconds"), "ad_id").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("w"), "ad_id", "n")
    mine = ads.sliding_ad_clicks_by_pane(clicks, 3600, 10).toDF("w", "ad_id", "n")
    assert plain.exceptAll(mine).count() == 0 == mine.exceptAll(plain).count()
    assert math.isclose(ads.busiest_windows(clicks).agg(F.sum("windows")).first()[0], plain.count())
    with pytest.raises(ValueError):
        ads.sliding_click_runs(clicks, 25, 10)


# --- pruning ----------------------------------------------------------------------------------


def test_date_range_reaches_the_scan(spark, sf_dir):
    dates = ("2024-01-05", "2024-01-25")
    bounded, plain = (readers.actions_by_date(adapters.user_visit_action(spark, sf_dir, d), *dates) for d in (dates, None))
    pushed = next(line for line in plan_of(bounded).splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in pushed and "LessThan(ts,2024-01-26T00:00)" in pushed
    assert rows_of(bounded) == rows_of(plain)
    for query in (sessions.aggregate_sessions(bounded), readers.click_actions_by_date(adapters.user_visit_action(spark, sf_dir, dates), *dates)):
        assert "GreaterThanOrEqual(ts" in plan_of(query)


def test_bounds_of_each_kind(spark):
    texts = ["2024-01-04 23:59:59", "2024-01-05 00:00:00", "2024-01-07 23:59:59", "2024-01-08 00:00:00", None]
    for kind in ("timestamp", "timestamp_ntz", "date"):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast(kind).alias("time"))
        assert df.where(readers.between_dates(F.col("time"), kind, "2024-01-05", "2024-01-07")).count() == 2


def test_dates_are_folders(spark, sf_dir, tmp_path):
    actions = adapters.user_visit_action(spark, sf_dir)
    readers.write_by_date(actions, f"file://{tmp_path}/a")
    back = readers.read_by_date(spark, f"file://{tmp_path}/a", USER_VISIT_ACTION + ", event_id long")
    chosen = readers.actions_by_date(back, "2024-01-05", "2024-01-07")
    filters = next(line for line in plan_of(chosen).splitlines() if "PartitionFilters" in line)
    assert "date" in filters and "2024-01-05" in filters and "2024-01-07" in filters
    assert rows_of(chosen.select(*actions.columns)) == rows_of(readers.actions_by_date(actions, "2024-01-05", "2024-01-07"))
