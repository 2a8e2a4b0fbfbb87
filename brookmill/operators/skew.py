"""Helpers for hot keys; each gives the rows of the plain operator.

Spark's own skew join covers most cases.  These are for lists and distinct values, which
have no small partial result, and for joins that Spark can't split.  A row's salt is a hash of
its columns, or of those named by ``row_id``, so a row that is computed again keeps it; rows that
are equal in all of these share a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import group_concat_distinct


def _row_hash(df: DataFrame, row_id: list[str] | None = None) -> Column:
    return F.xxhash64(*(row_id or df.columns), F.lit(29))


def _salt(df: DataFrame, salt: int, row_id: list[str] | None = None) -> Column:
    return F.pmod(_row_hash(df, row_id), F.lit(salt)).cast("int")


def salted_count(df: DataFrame, keys: list[str], salt: int = 10) -> DataFrame:
    """Rows of each key, counted in two steps."""
    parts = df.select(*keys, _salt(df, salt).alias("_salt")).groupBy(*keys, "_salt").agg(F.count("*").alias("n"))
    return parts.groupBy(keys).agg(F.sum("n").alias("row_count"))


def salted_distinct(df: DataFrame, keys: list[str], value: str, salt: int = 10) -> DataFrame:
    """Distinct non-null values of each key, sorted, and their number: columns keys, values, n_values.

    Equal values have equal salts, so the sets of a key's salts are disjoint: the first step
    drops repetitions with 1/salt of a hot key's values in a task, the second only puts the sets
    together.  A key without values has an empty list.
    """
    part = F.pmod(F.xxhash64(value, F.lit(31)), F.lit(salt)).cast("int")
    sets = df.select(*keys, value, part.alias("_salt")).groupBy(*keys, "_salt").agg(F.collect_set(value).alias("some"))
    merged = sets.groupBy(keys).agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("values"))
    return merged.select(*keys, "values", F.size("values").cast("bigint").alias("n_values"))


def salted_group_concat(df: DataFrame, keys: list[str], value: str, name: str, sep: str = ",", salt: int = 10) -> DataFrame:
    """``group_concat_distinct`` of a text column in two steps, for hot keys."""
    return salted_distinct(df.withColumn(value, F.col(value).cast("string")), keys, value, salt).select(*keys, F.array_join("values", sep).alias(name))


def plain_group_concat(df: DataFrame, keys: list[str], value: str, name: str, sep: str = ",") -> DataFrame:
    return df.groupBy(keys).agg(group_concat_distinct(F.col(value).cast("string"), sep).alias(name))


def salted_join(left: DataFrame, right: DataFrame, key: str, salt: int = 10, row_id: list[str] | None = None) -> DataFrame:
    """Inner join; rows of ``left`` are spread over ``salt`` copies of ``right``."""
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.withColumn("_salt", _salt(left, salt, row_id)).join(copies, [key, "_salt"]).drop("_salt")


def hot_keys(df: DataFrame, key: str, sample_fraction: float = 0.1, top_n: int = 1, seed: int = 9) -> DataFrame:
    """The most frequent keys of a sample."""
    counts = df.select(key).where(F.col(key).isNotNull()).sample(False, sample_fraction, seed).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(top_n).select(key)


def skew_isolated_join(left: DataFrame, right: DataFrame, key: str, sample_fraction: float = 0.1, salt: int = 100, top_n: int = 1) -> DataFrame:
    """Inner join; the hottest keys go through the salted join, the others as usual."""
    hot = [r[0] for r in hot_keys(left, key, sample_fraction, top_n).collect()]  # top_n values
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    rest = left.where(~is_hot).join(right.where(~is_hot), key)
    return rest.unionByName(salted_join(left.where(is_hot), right.where(is_hot), key, salt)) if hot else rest


def heavy_keys(df: DataFrame, key: str, tasks: int, tracked: int = 4096) -> DataFrame:
    """(key, weight, salts) of keys that hold more rows than one of ``tasks`` equal shares.

    A summary of frequent items is kept in every task over all its rows and the summaries are
    merged, so the cost is one pass without a shuffle of rows.  There are fewer than ``tasks``
    such keys, and none is missed: 16 counters a task err by less than half a share.  A key gets as many
    salts as shares it holds.
    """
    tracked = max(tracked, 16 * tasks)
    known = df.where(F.col(key).isNotNull()).select(key)
    found = known.agg(F.count("*").alias("total"), F.expr(f"approx_top_k(`{key}`, {tasks}, {tracked})").alias("top"))
    each = found.select("total", F.explode("top").alias("t")).select("total", F.col("t.item").alias(key), F.col("t.count").alias("weight"))
    salts = F.ceil(F.col("weight") * tasks / F.col("total")).cast("int")
    return each.where(F.col("weight") * tasks > F.col("total")).select(key, "weight", salts.alias("salts"))


def weighted_skew_join(left: DataFrame, right: DataFrame, key: str, tasks: int | None = None, row_id: list[str] | None = None) -> DataFrame:
    """Inner join; each heavy key of ``left`` is spread over salts in proportion to its measured rows.

    No sample and no constant: a key's share of all rows decides, and a key that holds no
    more than a share stays whole.  ``right`` is copied only for heavy keys.  The table of heavy keys,
    fewer than ``tasks`` (the shuffle's partitions by default), is broadcast.
    """
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(left, key, tasks).select(key, F.col("salts").alias("_salts")))
    spread = left.withColumn("_hash", _row_hash(left, row_id)).join(heavy, key, "left")
    spread = spread.withColumn("_salt", F.pmod("_hash", F.coalesce("_salts", F.lit(1))).cast("int")).drop("_hash", "_salts")
    copies = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copies, [key, "_salt"]).drop("_salt")
