"""Hand-computed answers for the scalar functions, filters and buckets."""

import pytest
from pyspark.sql import functions as F

from brookmill.functions import columns as C
from brookmill.functions import filters as P
from brookmill.params import TaskParams


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_visit_buckets(spark):
    seconds = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    expected = [None, *["1s_3s"] * 2, *["4s_6s"] * 2, *["7s_9s"] * 2, *["10s_30s"] * 2, *["30s_60s"] * 2, *["1m_3m"] * 2, *["3m_10m"] * 2, *["10m_30m"] * 2, "30m"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "i int, s long")
    assert [r[0] for r in df.orderBy("i").select(C.visit_length_bucket(F.col("s"))).collect()] == expected


def test_step_buckets(spark):
    steps = [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61]
    expected = [*["1_3"] * 2, *["4_6"] * 2, *["7_9"] * 2, *["10_30"] * 2, *["30_60"] * 2, "60"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "i int, s long")
    assert [r[0] for r in df.orderBy("i").select(C.step_length_bucket(F.col("s"))).collect()] == expected


@pytest.mark.parametrize(
    "area, level",
    [("China North", "A Level"), ("China East", "A Level"), ("China South", "B Level"), ("China Middle", "B Level"), ("West North", "C Level"), ("West South", "C Level"), ("Northeast", "D Level"), (None, "D Level")],
)
def test_area_level(spark, area, level):
    assert one(spark, area, C.area_level) == level


@pytest.mark.parametrize("info, status", [('{"product_status":0}', "Self"), ('{"product_status": 1}', "Third Party"), ("bad", "Third Party"), (None, "Third Party")])
def test_product_status(spark, info, status):
    assert one(spark, info, C.product_status) == status


@pytest.mark.parametrize("text, value", [("k=v", "v"), ("k=", None), ("k=v=", "v"), ("k==v", None), ("k=a=b", None), ("xk=1|k=2", "2"), ("k=v|k=w", "v")])
def test_get_field(spark, text, value):
    assert one(spark, text, lambda c: C.get_field(c, "k")) == value


@pytest.mark.parametrize("text, value", [("k=v", "k=N"), ("a=1|k=v|k=w", "a=1|k=N|k=w"), ("xk=1", "xk=1"), ("k=", "k=N")])
def test_set_field(spark, text, value):
    assert one(spark, text, lambda c: C.set_field(c, "k", "N")) == value


def test_text_helpers(spark):
    assert one(spark, ",a,b,", C.trim_comma) == "a,b"
    assert [one(spark, x, C.pad_two) for x in ("", "5", "12", "123")] == ["0", "05", "12", "0123"]
    assert [one(spark, x, C.is_empty) for x in (None, "", " ")] == [True, True, False]
    assert one(spark, "1,2,,x", C.csv_to_longs) == [1, 2, None]
    assert one(spark, "3_a_b", C.remove_prefix) == "a_b"
    assert one(spark, None, lambda c: C.concat_long_string(F.lit(7), ":", c)) == "7:null"
    assert one(spark, "[{'a': '1'}, {'a': '2'}]", lambda c: C.first_json_field(c, "a")) == "1"


def test_time_helpers(spark):
    assert one(spark, "2024-01-01 5:03:09", lambda c: C.minus_seconds(c, F.lit("2024-01-01 05:03:00"))) == 9
    assert one(spark, "bad", lambda c: C.minus_seconds(c, F.lit("2024-01-01 05:03:00"))) == 0
    assert one(spark, "bad", lambda c: C.before(c, F.lit("2024-01-01 05:03:00"))) is False
    assert one(spark, "2024-01-01 5:03:09", C.date_hour) == "2024-01-01_5"


def test_filters_pass_and_fail(spark):
    assert one(spark, 5, lambda c: P.between_or_pass(c, 10, None), "int") is True
    assert one(spark, None, lambda c: P.between_or_pass(c, 1, 9), "int") is False
    assert one(spark, None, lambda c: P.in_or_pass(c, ("a",))) is False
    assert one(spark, None, lambda c: P.in_or_pass(c, None)) is True
    assert one(spark, ["kw10"], lambda c: P.overlap_or_pass(c, ("kw1",)), "array<string>") is False
    assert one(spark, "x", lambda c: P.equal_or_pass(c, "x")) is True


def test_task_params(spark):
    p = TaskParams.from_json('{"startDate": ["2024-01-01"], "startAge": ["20"], "keywords": ["a,b"], "targetPageFlow": ["3,5"], "cities": []}')
    assert (p.start_date, p.start_age, p.end_age, p.keywords, p.page_flow, p.cities) == ("2024-01-01", 20, None, ("a", "b"), (3, 5), None)
    tasks = spark.createDataFrame([(1, '{"sex": ["male"]}')], "task_id long, task_param string")
    assert TaskParams.of_task(tasks, 1).sex == "male"
    with pytest.raises(LookupError):
        TaskParams.of_task(tasks, 2)
