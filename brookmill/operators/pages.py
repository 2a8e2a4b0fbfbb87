"""Page-to-page conversion along a given flow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parse_time


def page_splits(actions: DataFrame, tie: str = "event_id") -> DataFrame:
    """(session_id, from_page, to_page) of consecutive actions of a session."""
    order = Window.partitionBy("session_id").orderBy(parse_time(F.col("action_time")), tie)
    steps = actions.select("session_id", F.col("page_id").alias("from_page"), F.lead("page_id").over(order).alias("to_page"))
    return steps.where("from_page is not null and to_page is not null")


def ranged_page_splits(actions: DataFrame, tie: str = "event_id", ranges: int | None = None) -> DataFrame:
    """The rows of ``page_splits``, for sessions too long for one task.

    Actions are ranged by session and time, so a session of any length lies in as many ranges
    as its actions ask for.  Pairs inside a range are found in one vectorised pass; the first and
    the last action of every range, two rows each, are then put together over the borders.
    """
    spark = actions.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("session_id"), F.asc_nulls_first("_time"), F.asc_nulls_first(tie)]
    timed = actions.select("session_id", "page_id", parse_time(F.col("action_time")).alias("_time"), tie)
    ranged = timed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("session_id", "page_id", F.spark_partition_id().alias("part"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (session, page, part) of the row before the batch
        for batch in batches:
            if not batch.num_rows:
                continue
            session, page = batch.column(0), batch.column(1)
            part = batch.column(2)[0].as_py()
            before = pa.array([last[0] if last else None], pa.string()), pa.array([last[1] if last else None], pa.int64())
            earlier = pa.concat_arrays([before[0], session[:-1]]), pa.concat_arrays([before[1], page[:-1]])
            same = pc.fill_null(pc.equal(earlier[0], session), False).to_numpy(zero_copy_only=False) | (pc.is_null(earlier[0]).to_numpy(zero_copy_only=False) & pc.is_null(session).to_numpy(zero_copy_only=False))
            if last is None:
                same[0] = False
                yield _split_rows([session[0].as_py()], [page[0].as_py()], [None], part, "first")
            held = same & pc.is_valid(earlier[1]).to_numpy(zero_copy_only=False) & pc.is_valid(page).to_numpy(zero_copy_only=False)
            at = pa.array(np.flatnonzero(held))
            yield _split_rows(session.take(at), earlier[1].take(at), page.take(at), None, None)
            last = (session[-1].as_py(), page[-1].as_py(), part)
        if last is not None:
            yield _split_rows([last[0]], [last[1]], [None], last[2], "last")

    found = ranged.mapInArrow(pairs, "session_id string, from_page long, to_page long, part int, edge string")
    inside = found.where("edge is null").select("session_id", "from_page", "to_page")
    # two rows a range: the last action of one and the first of the next
    step = Window.orderBy("part", F.col("edge") == "last")
    edges = found.where("edge is not null").select("session_id", "from_page", "edge", F.lead(F.struct("session_id", F.col("from_page").alias("page"))).over(step).alias("next"))
    over = edges.where((F.col("edge") == "last") & F.col("next.session_id").eqNullSafe(F.col("session_id")) & F.col("from_page").isNotNull() & F.col("next.page").isNotNull() & F.col("next").isNotNull())
    return inside.unionByName(over.select("session_id", "from_page", F.col("next.page").alias("to_page")))


def _split_rows(session, start, end, part: int | None, edge: str | None) -> pa.RecordBatch:
    n = len(session)
    columns = [pa.array(session, pa.string()) if isinstance(session, list) else session, pa.array(start, pa.int64()) if isinstance(start, list) else start, pa.array(end, pa.int64()) if isinstance(end, list) else end]
    return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string())], names=["session_id", "from_page", "to_page", "part", "edge"])


def _flow_pairs(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(flow, flow[1:]), 1)]
    return actions.sparkSession.createDataFrame(rows, "position int, from_page long, to_page long")


def page_split_pv(actions: DataFrame, flow: tuple[int, ...], tie: str = "event_id") -> DataFrame:
    """How often each pair of the flow occurs; pairs that never do are missing."""
    wanted = F.broadcast(_flow_pairs(actions, flow).select("from_page", "to_page").distinct())  # as long as the flow
    return page_splits(actions, tie).join(wanted, ["from_page", "to_page"], "left_semi").groupBy("from_page", "to_page").agg(F.count("*").alias("pv"))


def start_page_pv(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    return actions.where(F.col("page_id") == flow[0]).agg(F.count("*").alias("pv"))


def page_convert_rate(actions: DataFrame, flow: tuple[int, ...], tie: str = "event_id") -> DataFrame:
    """Share of the previous step's views that go on, to two digits; null after a step without views."""
    pv = _flow_pairs(actions, flow).join(page_split_pv(actions, flow, tie), ["from_page", "to_page"], "left").withColumn("pv", F.coalesce("pv", F.lit(0)))
    start = start_page_pv(actions, flow).select(F.lit(0).alias("position"), "pv")
    steps = start.unionByName(pv, allowMissingColumns=True)  # a row for each pair of the flow, and one before them
    before = F.nullif(F.lag("pv").over(Window.orderBy("position")), F.lit(0))
    rates = steps.withColumn("before", before).where("position > 0")
    return rates.select("position", "from_page", "to_page", "pv", F.round(F.col("pv") / F.col("before"), 2).alias("convert_rate"))


def format_convert_rate(rates: DataFrame) -> DataFrame:
    """One text ``a_b=0.33|b_c=0.5`` in the order of the flow."""
    text = F.concat(F.concat_ws("_", "from_page", "to_page"), F.lit("="), F.coalesce(F.col("convert_rate").cast("string"), F.lit("null")))
    ordered = F.array_sort(F.collect_list(F.struct("position", text.alias("t"))))
    return rates.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "|").alias("convert_rate"))
