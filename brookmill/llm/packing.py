"""Operator 10: packing token sequences by a configuration linear program.

The lengths of all pieces are counted by Spark, which leaves at most ``capacity`` numbers.
Over that histogram the driver solves the configuration LP: a configuration is a multiset
of lengths that fits one sequence, and the LP asks for amounts of configurations that cover
the histogram with the fewest sequences.  Multiplicative weights keep a price for each
length, a knapsack dynamic program finds the most valuable configurations at those prices,
and the prices of what has been covered fall.  Rounding sums the
amounts up over all configurations, so that many small ones count together; what it leaves is
solved and rounded again, and the last few pieces go best fit, longest first, still as counts.  The plan is a list of
configurations and how often each is used; its size depends on the number of distinct
lengths, not on the corpus.  Spark then ranks the pieces of each length and reads every
piece's place off the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, parallelism, text_slices, written
from .tokens import TEXT_SLICE, encoder

Configuration = tuple[tuple[int, int], ...]  # (length, how many), longest first

#: Rounds of price updates, and configurations taken in each round.
ROUNDS, TAKEN = 60, 256
#: Rounds for what rounding has left; share of all ids in the short pieces that are kept back.
LATER_ROUNDS, FILLERS = 20, 0.002
#: Share of the scarcest length's demand that one step covers; strength of a price update.
STEP, RATE = 0.1, 0.5


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, and the index of the item added last (-1: none)."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        value[room], last[room] = value[room - 1], -2  # -2: one unit stays empty
        if k := fits[room]:
            gains = value[room - lengths[:k]] + prices[:k]
            best = int(gains.argmax())
            if gains[best] > value[room]:
                value[room], last[room] = gains[best], best
    return value, last


def _trace(last: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    items = []
    while room > 0:
        item = last[room]
        if item == -2:
            room -= 1
        elif item < 0:
            break
        else:
            items.append(int(item))
            room -= int(lengths[item])
    return items


def configuration_lp(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> dict[Configuration, float]:
    """Amounts of configurations that cover the histogram about once, and few sequences."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    prices = lengths / capacity  # these are optimal duals wherever sequences can be filled
    covered = np.zeros(len(lengths))
    amounts: dict[Configuration, float] = {}
    for _ in range(rounds):
        value, last = knapsack(lengths, prices, capacity)
        gained = np.zeros(len(lengths))
        for i in np.argsort(covered / demand, kind="stable")[:TAKEN].tolist():
            items = Counter([i, *_trace(last, lengths, capacity - int(lengths[i]))])
            chosen, times = np.array(list(items)), np.array(list(items.values()), float)
            step = STEP * float((demand[chosen] / times).min())
            key = tuple(sorted(((int(lengths[j]), n) for j, n in items.items()), reverse=True))
            amounts[key] = amounts.get(key, 0.0) + step
            gained[chosen] += step * times
        covered += gained
        prices = prices * np.exp(-RATE * gained / demand)
        prices /= value[capacity] or 1.0
    total = float((covered * lengths).sum() / (demand * lengths).sum())
    return {k: v / total for k, v in amounts.items()}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Best fit decreasing on counts: equal sequences are handled together."""
    open_by_room: dict[int, list[tuple[Configuration, int]]] = {capacity: []}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in open_by_room if length <= r < capacity):
            if not left:
                break
            fit = room // length
            groups, open_by_room[room] = open_by_room[room], []
            for config, n in groups:
                full = min(n, left // fit)
                if full:
                    open_by_room.setdefault(room - fit * length, []).append(((*config, (length, fit)), full))
                    left -= full * fit
                if n > full and 0 < left < fit:
                    open_by_room.setdefault(room - left * length, []).append(((*config, (length, left)), 1))
                    full, left = full + 1, 0
                if n > full:
                    open_by_room[room].append((config, n - full))
            if not open_by_room[room]:
                del open_by_room[room]
        fit = capacity // length
        if left >= fit:
            open_by_room.setdefault(capacity - fit * length, []).append((((length, fit),), left // fit))
        if left % fit:
            open_by_room.setdefault(capacity - left % fit * length, []).append((((length, left % fit),), 1))
    return [group for room in sorted(open_by_room) for group in open_by_room[room]]


def rounded(amounts: dict[Configuration, float], left: dict[int, int]) -> list[tuple[Configuration, int]]:
    """Whole uses of configurations; ``left`` loses their pieces.

    Configurations that leave more room than the program's do on average are not used, so a use is
    never worse than the program.  Down an order of the others the amounts are summed up, and
    one is used as often as the sum passes a whole number there: amounts below one count
    together instead of all being lost.  One that asks for more than is left is used as often as it can be.
    """
    filled = {c: sum(length * n for length, n in c) for c in amounts}
    mean = sum(filled[c] * x for c, x in amounts.items()) / sum(amounts.values())
    mean = min(mean, max(filled.values()))
    uses, passed = [], 0.0
    for config in sorted((c for c in amounts if filled[c] >= mean), reverse=True):
        wanted = int(passed + amounts[config]) - int(passed)
        passed += amounts[config]
        times = min(wanted, *(left[length] // n for length, n in config)) if wanted else 0
        if times:
            uses.append((config, times))
            for length, n in config:
                left[length] -= times * n
    return uses


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations and how often each is used; they hold the histogram exactly."""
    return plan_with_share(histogram, capacity)[0]


def plan_with_share(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Configuration, int]], int]:
    """The plan, and how many of its first entries come from the program.

    The program is solved and rounded, then solved and rounded for what is left, and so on.
    The shortest pieces, FILLERS of all ids, are kept back for the end, when what is left goes best fit.
    The last pieces of all may fit together badly, so of all times to stop the one that needs
    fewest sequences is taken, the latest of equals.
    """
    left = {k: v for k, v in histogram.items() if v}
    room, fillers = int(FILLERS * sum(k * v for k, v in left.items())), {}
    for length in sorted(left):
        if not (kept := min(left[length], room // length)):
            break
        fillers[length], room = kept, room - kept * length
    left = {k: v - fillers.get(k, 0) for k, v in left.items() if v > fillers.get(k, 0)}
    uses: list[tuple[Configuration, int]] = []
    best: tuple[int, int, list] | None = None
    rounds = max(ROUNDS, min(200, 100_000 // capacity))  # short sequences need more of them, and take less time
    while True:
        new = rounded(configuration_lp(left, capacity, rounds), left) if left else []
        uses += new
        rest = best_fit(dict(Counter(left) + Counter(fillers)), capacity)
        needed = sum(n for _, n in uses) + sum(n for _, n in rest)
        if best is None or needed <= best[0]:
            best = (needed, len(uses), rest)
        if not new:
            return uses[: best[1]] + best[2], best[1]
        left = {k: v for k, v in left.items() if v}
        rounds = max(LATER_ROUNDS, min(80, 40_000 // capacity))


def _places(plan: list[tuple[Configuration, int]]) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: first rank, pieces a sequence, offset, first sequence."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: Counter = Counter()
    sequence = 0
    for config, times in plan:
        offset = 0
        for length, n in config:
            runs.setdefault(length, []).append((given[length], n, offset, sequence))
            given[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: texts as ids with ``end_id`` after each, cut at ``capacity``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, False)
        for batch in text_slices(batches, most=TEXT_SLICE):
            out: list[list] = [[], [], [], [], []]
            encoded, ends = enc.encode(batch.column(1), end_id)
            encoded = encoded.astype("<u4")
            for doc_id, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                ids = encoded[a:b]
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, x in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.data))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(giving_back(encode), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs all texts into as few sequences of at most ``capacity`` ids as the program finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  ``docs`` needs
    ``doc_id`` and ``text``; a null text is empty (one end id), rows that repeat an id are
    packed each on its own, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    shards = max(64, parallelism(spark))
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    # a length that a third of all pieces share is ranked in many shards
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = _places(packing_plan(histogram, capacity))
    before = counts.select("shard", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(before, ["shard", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                runs = places[int(lengths[part[0]])]
                run = runs[np.searchsorted(runs[:, 0], ranks[part], "right") - 1]
                nth = ranks[part] - run[:, 0]
                sequence[part] = run[:, 3] + nth // run[:, 1]
                offset[part] = run[:, 2] + nth % run[:, 1] * lengths[part]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(giving_back(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
