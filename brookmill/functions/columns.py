"""Scalar functions as column builders: text and time helpers, labels and buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DATE, DATE_KEY, MINUTE_KEY, TIME, TIME_READ

# --- time -------------------------------------------------------------------------------


def parse_time(text: Column) -> Column:
    """Timestamp of ``yyyy-MM-dd H:mm:ss``; null if it can't be read."""
    return F.try_to_timestamp(text, F.lit(TIME_READ))


def parse_date_key(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(DATE_KEY))


def before(a: Column, b: Column) -> Column:
    return F.coalesce(parse_time(a) < parse_time(b), F.lit(False))


def after(a: Column, b: Column) -> Column:
    return F.coalesce(parse_time(a) > parse_time(b), F.lit(False))


def minus_seconds(a: Column, b: Column) -> Column:
    """Whole seconds from b to a; 0 if either can't be read."""
    return F.coalesce(F.unix_timestamp(parse_time(a)) - F.unix_timestamp(parse_time(b)), F.lit(0))


def date_hour(text: Column) -> Column:
    """``yyyy-MM-dd_HH`` by splitting the text; no zero is added."""
    hour = F.substring_index(F.substring_index(text, " ", -1), ":", 1)
    return F.concat(F.substring_index(text, " ", 1), F.lit("_"), hour)


def format_date(ts: Column) -> Column:
    return F.date_format(ts, DATE)


def format_time(ts: Column) -> Column:
    return F.date_format(ts, TIME)


def format_date_key(ts: Column) -> Column:
    return F.date_format(ts, DATE_KEY)


def format_minute_key(ts: Column) -> Column:
    return F.date_format(ts, MINUTE_KEY)


def today() -> Column:
    return F.date_format(F.current_date(), DATE)


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), DATE)


# --- text -------------------------------------------------------------------------------


def is_empty(text: Column) -> Column:
    return text.isNull() | (text == "")


def trim_comma(text: Column) -> Column:
    """Without one comma at each end."""
    return F.regexp_replace(text, "^,|,$", "")


def pad_two(text: Column) -> Column:
    """Two characters stay; anything else gets one zero in front."""
    return F.when(F.length(text) == 2, text).otherwise(F.concat(F.lit("0"), text))


def get_field(text: Column, name: str) -> Column:
    """Value of ``name`` in ``k=v|k=v``: the first field with exactly one non-empty value, else null."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|\|){re.escape(name)}=([^=|]+)=*(?:\||$)", 1), F.lit(""))


def set_field(text: Column, name: str, value: str) -> Column:
    """Sets the first field of that name; a text without it stays."""
    new = f"{name}={value}".replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, rf"^((?:[^|]*\|)*?){re.escape(name)}(?:=[^|]*)?(\||$)", rf"$1{new}$2")


def split_csv(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda x: x != "")


def csv_to_longs(text: Column) -> Column:
    return F.transform(split_csv(text), lambda x: x.try_cast("bigint"))


def concat_long_string(number: Column, sep: str, text: Column) -> Column:
    """Number and text joined; a null is written ``null``."""
    return F.concat(F.coalesce(number.cast("string"), F.lit("null")), F.lit(sep), F.coalesce(text, F.lit("null")))


def add_prefix(value: Column, salt: int, *row_id: Column) -> Column:
    """``n_value`` with n below ``salt`` from a hash of the row's id, so that a retry repeats it."""
    return F.concat(F.pmod(F.xxhash64(*row_id), F.lit(salt)).cast("string"), F.lit("_"), value)


def remove_prefix(value: Column) -> Column:
    return F.regexp_extract(value, r"^[0-9]+_(.*)$", 1)


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def first_json_field(text: Column, name: str) -> Column:
    """``name`` of the first object of a JSON array; single quotes will do."""
    return F.from_json(text, f"array<struct<{name}:string>>")[0][name]


def round_half_up(x: Column, digits: int = 2) -> Column:
    return F.round(x, digits)


def group_concat_distinct(value: Column, sep: str = ",") -> Column:
    """Aggregate: distinct values joined in the order of their text."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


# --- labels and buckets -----------------------------------------------------------------

#: Level of each named area.
AREA_LEVELS = {
    "China North": "A Level",
    "China East": "A Level",
    "China South": "B Level",
    "China Middle": "B Level",
    "West North": "C Level",
    "West South": "C Level",
}

#: Name, least and greatest whole seconds of a visit; 0 s is in none.
VISIT_BUCKETS = [
    ("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60),
    ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None),
]
#: Name, least and greatest number of actions.
STEP_BUCKETS = [("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60), ("60", 61, None)]


def _case(pairs: list[tuple[Column, str]], default: str | None) -> Column:
    out = F.lit(default)
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def product_status(extend_info: Column) -> Column:
    return F.when(json_field(extend_info, "product_status") == "0", "Self").otherwise("Third Party")


def area_level(area: Column, levels: dict[str, str] = AREA_LEVELS, default: str = "D Level") -> Column:
    return _case([(area == name, level) for name, level in levels.items()], default)


def _in_bucket(x: Column, least: int, most: int | None) -> Column:
    return x >= least if most is None else x.between(least, most)


def visit_length_bucket(seconds: Column) -> Column:
    return _case([(_in_bucket(seconds, a, b), name) for name, a, b in VISIT_BUCKETS], None)


def step_length_bucket(steps: Column) -> Column:
    return _case([(_in_bucket(steps, a, b), name) for name, a, b in STEP_BUCKETS], None)
