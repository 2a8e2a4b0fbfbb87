"""Hand fixtures for the session, category, page, product and ad operators, merges and skew helpers."""

from pyspark.sql import functions as F

from brookmill.operators import ads, categories, pages, products, sessions, skew
from brookmill.schemas import USER_VISIT_ACTION
from brookmill.sources import merge, readers

NAMES = [c.split()[0] for c in USER_VISIT_ACTION.split(", ")]


def actions(spark, rows):
    """Rows of the columns that matter, in any order; ``n`` breaks ties."""
    full = [tuple({"date": "2024-01-01", "action_time": f"2024-01-01 5:00:{i:02d}", **r}.get(c) for c in NAMES) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, USER_VISIT_ACTION + ", event_id long")


def test_distinct_is_exact(spark):
    a = actions(spark, [{"session_id": "s", "user_id": 1, "click_category_id": c, "search_keyword": k} for c, k in ((12, "abc"), (1, "b"), (12, None))])
    row = sessions.aggregate_sessions(a).first()
    assert row["click_category_ids"] == [1, 12] and row["search_keywords"] == ["abc", "b"]
    assert (row["visit_length"], row["step_length"], row["start_time"]) == (2, 3, "2024-01-01 05:00:00")


def test_search_only_session_has_no_category(spark):
    a = actions(spark, [{"session_id": "s", "user_id": 1, "search_keyword": "x"}])
    assert sessions.aggregate_sessions(a).first()["click_category_ids"] == []
    assert categories.category_counts(a).count() == 0


def test_every_id_of_a_list_counts(spark):
    a = actions(spark, [{"session_id": "s", "order_category_ids": x} for x in ("1,2", "2,3")])
    assert sorted(map(tuple, categories.order_category_counts(a).collect())) == [(1, 1), (2, 2), (3, 1)]


def test_category_ties(spark):
    rows = [{"click_category_id": c} for c in (1, 2, 3, 4, 5)] + [{"order_category_ids": "2"}, {"order_category_ids": "3"}, {"pay_category_ids": "3"}]
    assert [r[0] for r in categories.top10_category(actions(spark, rows)).collect()] == [3, 2, 1, 4, 5]


def test_funnel(spark):
    rows = [{"session_id": "a", "page_id": p} for p in (3, 5, 2, 8, 3, 5)] + [{"session_id": "b", "page_id": p} for p in (3, 2)]
    rates = pages.page_convert_rate(actions(spark, rows), (3, 5, 2, 8, 9)).orderBy("position").collect()
    assert [(r["pv"], r["convert_rate"]) for r in rates] == [(2, 0.67), (1, 0.5), (1, 1.0), (0, 0.0)]
    text = pages.format_convert_rate(pages.page_convert_rate(actions(spark, rows), (3, 5, 2))).first()[0]
    assert text == "3_5=0.67|5_2=0.5"


def test_funnel_without_a_start(spark):
    rates = pages.page_convert_rate(actions(spark, [{"session_id": "a", "page_id": 1}]), (3, 5)).first()
    assert rates["pv"] == 0 and rates["convert_rate"] is None


def test_city_list(spark):
    basic = spark.createDataFrame([(1, "x", "A", 7), (11, "x", "A", 7), (1, "x", "A", 7)], "city_id long, city_name string, area string, product_id long")
    assert products.area_product_click_count(basic).select("city_infos", "click_count").first()[:] == ("11:x,1:x", 3)


def quota_rows(spark, days):
    rows = [(d, h, n) for d in range(days) for h, n in (("01", 1), ("02", 2), ("03", 97))]
    return sessions.extract_quota(spark.createDataFrame([(f"2024-01-0{d + 1}", h, n) for d, h, n in rows], "date string, hour string, session_count long"))


def test_quota(spark):
    assert {r["hour"]: r["quota"] for r in quota_rows(spark, 1).collect()} == {"01": 1, "02": 2, "03": 97}
    assert {r["hour"]: r["quota"] for r in quota_rows(spark, 3).collect()} == {"01": 0, "02": 0, "03": 32}


def test_empty_sessions(spark):
    none = sessions.aggregate_sessions(actions(spark, []))
    assert sessions.session_aggr_stat(none, 1).first()["visit_30m_ratio"] is None
    assert sessions.random_extract_sessions(none).count() == 0


def test_dynamic_blacklist_keeps_the_crossing(spark):
    clicks = spark.createDataFrame([(f"2024-01-01 00:00:0{i}", 1, 1, i) for i in range(5)], "ts string, user_id long, ad_id long, event_id long").withColumn("ts", F.to_timestamp("ts"))
    assert [r["event_id"] for r in ads.apply_dynamic_blacklist(clicks, 3).orderBy("event_id").collect()] == [0, 1, 2]


def test_merges(spark):
    schema = "d string, p string, n long"
    current = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "x", 4)], schema)
    updates = spark.createDataFrame([("a", "x", 10), ("a", "w", 20)], schema)
    got = lambda df: sorted(map(tuple, df.select("d", "p", "n").collect()))
    assert got(merge.upsert_overwrite(current, updates, ["d", "p"])) == [("a", "w", 20), ("a", "x", 10), ("a", "y", 2), ("a", "z", 3), ("b", "x", 4)]
    assert got(merge.upsert_add(current, updates, ["d", "p"], "n"))[:2] == [("a", "w", 20), ("a", "x", 11)]
    assert got(merge.replace_groups(current, updates, ["d"])) == [("a", "w", 20), ("a", "x", 10), ("b", "x", 4)]
    assert got(merge.lookup_counts(updates, current, ["d", "p"], "n")) == [("a", "w", 0), ("a", "x", 1)]
    once = merge.upsert_overwrite(current, updates, ["d", "p"])
    assert got(merge.upsert_overwrite(once, updates, ["d", "p"])) == got(once)


def test_skew_helpers_equal_plain_joins(spark):
    left = spark.createDataFrame([(1 if i % 3 else i % 7, i) for i in range(500)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(7)], "k long, name string")
    rows = lambda df: sorted(map(tuple, df.select("k", "v", "name").collect()))
    plain = rows(left.join(right, "k"))
    assert rows(skew.salted_join(left, right, "k", 4)) == plain
    assert rows(skew.skew_isolated_join(left, right, "k", 0.5, 4)) == plain
    assert sorted(map(tuple, skew.salted_count(left, ["k"], 4).collect())) == sorted(map(tuple, left.groupBy("k").count().collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\x01null\x01b\n2\x01a\x01null\n")
    assert readers.read_ctrl_a(spark, f"file://{tmp_path}/t.txt", "i long, a string, b string").orderBy("i").collect() == [(1, None, "b"), (2, "a", None)]
    lines = spark.createDataFrame([("1704067200000 P C 5 6",), ("bad",)], "value string")
    good, bad = readers.parse_ad_log(lines).orderBy(F.col("user_id").asc_nulls_last()).collect()
    assert (good["province"], good["user_id"], good["ad_id"], str(good["ts"])[:10]) == ("P", 5, 6, "2024-01-01")
    assert bad["ts"] is None and bad["user_id"] is None
