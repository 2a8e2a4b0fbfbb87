"""The four jobs, their sources and their result tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from brookmill.functions import columns as C
from brookmill.operators import sessions
from brookmill.params import TaskParams
from brookmill.plans import jobs
from brookmill.sources import adapters, merge, readers
from brookmill.sources.database import GUARD, Database
from brookmill.streaming import ads as stream

TASK = '{"startDate": ["2024-01-05"], "endDate": ["2024-01-25"], "startAge": ["20"], "endAge": ["50"], "sex": ["male"], "keywords": ["kw1,kw2,kw3,kw4,kw5,kw6,kw7"], "targetPageFlow": ["3,5,2,8"]}'


def rows_of(df, *columns):
    return sorted(map(repr, (tuple(r) for r in (df.select(*columns) if columns else df).collect())))


@pytest.fixture(scope="module")
def shop(spark, sf_dir):
    tasks = spark.createDataFrame([(7, TASK)], "task_id long, task_param string")
    return {
        "actions": adapters.user_visit_action(spark, sf_dir), "users": adapters.user_info(spark, sf_dir), "goods": adapters.product_info(spark, sf_dir), "cities": adapters.city_info(spark, sf_dir),
        "clicks": adapters.ad_clicks(spark, sf_dir), "task": TaskParams.of_task(tasks, 7),
    }


# --- jobs ------------------------------------------------------------------------------------


def test_session_job(shop):
    """Its tables agree with plain Python over the same actions."""
    found = jobs.session_job(shop["actions"], shop["users"], shop["task"], 7)
    users = {r["user_id"]: r for r in shop["users"].collect()}
    held = {}
    for a in shop["actions"].where("date between '2024-01-05' and '2024-01-25'").collect():
        held.setdefault(a["session_id"], []).append(a)
    wanted = {f"kw{i}" for i in range(1, 8)}
    passing = {s: rows for s, rows in held.items() if (u := users.get(rows[0]["user_id"])) and 20 <= u["age"] <= 50 and u["sex"] == "male" and wanted & {r["search_keyword"] for r in rows}}
    assert {r["session_id"] for r in found["sessions"].collect()} == set(passing) and passing
    details = [a for rows in passing.values() for a in rows]
    assert found["details"].count() == len(details)
    stat = found["session_aggr_stat"].first()
    assert stat["task_id"] == 7 and stat["session_count"] == len(passing)
    assert stat["step_1_3_ratio"] == round(sum(len(r) <= 3 for r in passing.values()) / len(passing) + 1e-9, 2)
    counts = {}
    for a in details:
        if a["click_category_id"] is not None:
            counts.setdefault(a["click_category_id"], [0, 0, 0])[0] += 1
        for at, name in ((1, "order_category_ids"), (2, "pay_category_ids")):
            for c in (a[name] or "").split(","):
                if c:
                    counts.setdefault(int(c), [0, 0, 0])[at] += 1
    top = sorted(((-n[0], -n[1], -n[2], c) for c, n in counts.items()))[:10]
    assert [(-r["click_count"], -r["order_count"], -r["pay_count"], r["category_id"]) for r in sorted(found["top10_category"].collect(), key=lambda r: (-r["click_count"], -r["order_count"], -r["pay_count"], r["category_id"]))] == top
    best = {}
    for a in details:
        if a["click_category_id"] in {t[3] for t in top}:
            key = a["click_category_id"], a["session_id"]
            best[key] = best.get(key, 0) + 1
    expected = [(c, s, n) for (c, s), n in best.items() if sorted((-m, t) for (d, t), m in best.items() if d == c).index((-n, s)) < 10]
    assert rows_of(found["top10_session"], "category_id", "session_id", "click_count") == sorted(map(repr, expected))
    drawn = {r["session_id"] for r in found["session_random_extract"].collect()}
    assert drawn <= set(passing)
    kept = drawn | {s for _, s, _ in expected}
    assert found["session_detail"].count() == sum(len(passing[s]) for s in kept)
    found["sessions"].unpersist()
    found["details"].unpersist()


def test_page_and_product_jobs(spark, shop):
    one = jobs.page_job(shop["actions"], shop["task"], 7).collect()
    assert len(one) == 1 and one[0]["task_id"] == 7
    parts = dict(p.split("=") for p in one[0]["convert_rate"].split("|"))
    assert list(parts) == ["3_5", "5_2", "2_8"]
    pages, order = {}, {}
    for a in shop["actions"].where("date between '2024-01-05' and '2024-01-25'").collect():
        order.setdefault(a["session_id"], []).append((a["action_time"], a["event_id"], a["page_id"]))
    for rows in order.values():
        flow = [p for _, _, p in sorted(rows)]
        for pair in zip(flow, flow[1:]):
            pages[pair] = pages.get(pair, 0) + 1
    start = sum(p == 3 for rows in order.values() for _, _, p in rows)
    assert float(parts["3_5"]) == pytest.approx(pages[3, 5] / start, abs=0.006)
    top = jobs.product_job(shop["actions"], shop["cities"], shop["goods"], shop["task"], 7)
    assert top.columns[0] == "task_id" and all(n <= 3 for n in [r["count"] for r in top.groupBy("area").count().collect()])
    clicks = [(a["city_id"], a["click_product_id"]) for a in shop["actions"].where("date between '2024-01-05' and '2024-01-25' and click_product_id is not null").collect()]
    areas, goods, n = {r["city_id"]: r["area"] for r in shop["cities"].collect()}, {r["product_id"] for r in shop["goods"].collect()}, {}
    for city, product in clicks:
        if product in goods:
            n[areas[city], product] = n.get((areas[city], product), 0) + 1
    expected = [(a, p, c) for (a, p), c in n.items() if sorted((-m, q) for (b, q), m in n.items() if b == a).index((-c, p)) < 3]
    assert rows_of(top, "area", "product_id", "click_count") == sorted(map(repr, expected))


def test_ad_job(shop):
    found = jobs.ad_job(shop["clicks"], 3)
    counts = {}
    for c in shop["clicks"].orderBy("ts", "event_id").collect():
        key = str(c["ts"])[:10], c["user_id"], c["ad_id"]
        counts[key] = counts.get(key, 0) + 1
    listed = {u for (_, u, _), n in counts.items() if n >= 3}
    assert {r["user_id"] for r in found["ad_blacklist"].collect()} == listed and listed
    assert found["ad_click_trend"].agg(F.sum("click_count")).first()[0] == shop["clicks"].count()
    kept = found["ad_user_click_count"].agg(F.sum("click_count")).first()[0]
    assert kept == found["ad_stat"].agg(F.sum("click_count")).first()[0] < shop["clicks"].count()
    assert found["ad_province_top3"].groupBy("date", "province").count().agg(F.max("count")).first()[0] <= 3


def test_tables_are_appended(spark, shop, tmp_path):
    one = {"page_split_convert_rate": jobs.page_job(shop["actions"], shop["task"], 7)}
    for _ in range(2):
        jobs.save(one, f"file://{tmp_path}")
    assert spark.read.parquet(f"file://{tmp_path}/page_split_convert_rate").count() == 2
    merge.append(one["page_split_convert_rate"], f"file://{tmp_path}/page_split_convert_rate")
    assert spark.read.parquet(f"file://{tmp_path}/page_split_convert_rate").count() == 3


def test_missing_task_is_an_error(spark):
    with pytest.raises(LookupError):
        TaskParams.of_task(spark.createDataFrame([(1, TASK)], "task_id long, task_param string"), 2)


def test_session_of_the_jobs(spark):
    assert jobs.session("again").conf.get("spark.sql.session.timeZone") == "UTC"


# --- database --------------------------------------------------------------------------------


@pytest.fixture
def database():
    return Database(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, text_length=200)


STAT = "date string, province string, ad_id long, click_count long"


def stat(spark, *rows):
    return spark.createDataFrame(list(rows), STAT)


def test_results_of_a_job_in_a_database(spark, shop, database):
    """Every result table is there, and a run that is repeated adds nothing."""
    tables = {"page_split_convert_rate": jobs.page_job(shop["actions"], shop["task"], 7), "area_top3_product": jobs.product_job(shop["actions"], shop["cities"], shop["goods"], shop["task"], 7)}
    assert jobs.save_to_database(tables, database, 7) == list(tables)
    assert jobs.save_to_database(tables, database, 7) == []
    for name, df in tables.items():
        assert rows_of(database.read(spark, name), *df.columns) == rows_of(df)
    assert jobs.save_to_database(tables, database, 8) == list(tables)
    assert database.read(spark, "page_split_convert_rate").count() == 2
    part = readers.read_jdbc(spark, database.url, '"area_top3_product"', '"product_id"', (1, 200), 3, **database.options)
    assert part.rdd.getNumPartitions() == 3 and part.count() == 2 * tables["area_top3_product"].count()


def test_overwriting_merge(spark, database):
    keys = ["date", "province", "ad_id"]
    assert database.upsert_overwrite(stat(spark, ("d", "p", 1, 5), ("d", "p", None, 6)), "ad_stat", keys, 0)
    assert database.upsert_overwrite(stat(spark, ("d", "p", 1, 9), ("d", "p", None, 7), ("e", "p", 1, 1)), "ad_stat", keys, 1)
    assert not database.upsert_overwrite(stat(spark, ("d", "p", 1, 100)), "ad_stat", keys, 1)
    assert not database.upsert_overwrite(stat(spark, ("d", "p", 1, 100)), "ad_stat", keys, 0)
    assert rows_of(database.read(spark, "ad_stat")) == sorted(map(repr, [("d", "p", 1, 9), ("d", "p", None, 7), ("e", "p", 1, 1)]))


def test_adding_merge(spark, database):
    for epoch, rows in enumerate([[("d", "p", 1, 5), ("d", "p", None, 1)], [("d", "p", 1, 2), ("d", "p", None, 1), ("d", "q", 1, 4)], []]):
        assert database.upsert_add(stat(spark, *rows), "ad_user_click_count", ["date", "province", "ad_id"], "click_count", epoch)
        assert not database.upsert_add(stat(spark, *rows), "ad_user_click_count", ["date", "province", "ad_id"], "click_count", epoch)
    assert rows_of(database.read(spark, "ad_user_click_count")) == sorted(map(repr, [("d", "p", 1, 7), ("d", "p", None, 2), ("d", "q", 1, 4)]))


def test_replacing_merge(spark, database):
    database.replace_groups(stat(spark, ("d", "p", 1, 5), ("d", "p", 2, 4), ("d", "q", 1, 3)), "ad_province_top3", ["date", "province"], 0)
    database.replace_groups(stat(spark, ("d", "p", 3, 9)), "ad_province_top3", ["date", "province"], 1)
    assert rows_of(database.read(spark, "ad_province_top3")) == sorted(map(repr, [("d", "p", 3, 9), ("d", "q", 1, 3)]))


def test_a_merge_that_fails_leaves_nothing(spark, database):
    keys = ["date", "province", "ad_id"]
    database.upsert_add(stat(spark, ("d", "p", 1, 2**62)), "t", keys, "click_count", 0)
    with pytest.raises(Exception):  # noqa: B017 - the sum is too large for the database
        database.upsert_add(stat(spark, ("d", "p", 1, 2**62), ("d", "q", 1, 1)), "t", keys, "click_count", 1)
    assert rows_of(database.read(spark, "t")) == [repr(("d", "p", 1, 2**62))]
    assert database.upsert_add(stat(spark, ("d", "q", 1, 1)), "t", keys, "click_count", 1)
    assert {r[1] for r in database.read(spark, GUARD).collect()} == {1}


# --- sources and small functions -----------------------------------------------------------------


def test_tables_of_the_catalog(spark, sf_dir):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert readers.load_table(spark, "three_rows").count() == 3
    assert readers.load_table(spark, "nation", sf_dir).count() == 25


def test_blacklist_source(spark, tmp_path):
    spark.createDataFrame([(7,), (9,)], stream.LISTED).write.parquet(f"file://{tmp_path}/l")
    assert {r[0] for r in readers.read_blacklist(spark, f"file://{tmp_path}/l").collect()} == {7, 9}


def test_kafka_source_needs_its_package(spark):
    """The package isn't here, so only the call itself is tried; the lines are parsed as elsewhere."""
    with pytest.raises(Exception, match="(?i)kafka"):
        readers.read_ad_stream_kafka(spark, "localhost:1", "AdRealTimeLog")


def test_today_and_yesterday(spark):
    import datetime

    row = spark.range(1).select(C.today(), C.yesterday()).first()
    now = datetime.datetime.now(datetime.timezone.utc).date()
    days = [str(now - datetime.timedelta(days=i)) for i in range(3)]
    assert (row[0], row[1]) in [(days[0], days[1]), (days[1], days[2])]


def test_users_joined_by_broadcast(shop):
    found = sessions.aggregate_sessions(shop["actions"])
    plain, small = (sessions.join_user(found, shop["users"], broadcast=b) for b in (False, True))
    assert rows_of(plain) == rows_of(small)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()


def test_field_names_with_signs(spark):
    """A dollar sign in the name stays itself in the replacement."""
    df = spark.createDataFrame([("a$1=x|b=y",)], "t string")
    assert df.select(C.set_field(F.col("t"), "a$1", "$2")).first()[0] == "a$1=$2|b=y"
