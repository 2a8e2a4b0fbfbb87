"""Operator 5: text quality by an ordinal cumulative-link regression.

Ratings are grades 0 .. K-1.  One set of weights over hashed features of the text gives a
score s, and ordered thresholds give P(grade <= k) = logistic(threshold_k - s), from which
follow the expected grade and the probability of reaching the upper grade.  Features are the
presence of words, of their beginnings, of runs of marks, and of words in capitals.  The model is fitted on
all rated texts by stochastic gradients on shards, whose weights are averaged after every
round; the bound of selection is an order statistic of all rated texts of the top grade.
Rated texts travel as their features, so that no text is shuffled, and a shard is one row of
bounded size, so that their number grows with the ratings and a round needs no shuffle of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written
from .hashing import HASH_SLICE, mix, piece_hashes

FEATURE_BITS = 18
#: Least shards, rated texts a shard, rounds, and rated texts a feature must be in.
SHARDS, SHARD_ROWS, ROUNDS, LEAST_TEXTS = 8, 8192, 10, 4
#: A feature is used if its share of upper grades is so many standard deviations off, or its
#: spread over the grades has so great a G statistic; the latter hardly depends on how many
#: texts of each grade there are.
LEAST_Z, LEAST_G = 3.0, 16.0
RATE, DECAY = 1.0, 1e-3
#: Thresholds stay ordered by so much at least; their distances are fitted.
LEAST_GAP = 0.01
#: Share of the rated top-grade texts that selection is to keep, and the steps of its bound:
#: 2 ** STEP_BITS to one, counted in two passes of half the bits.
KEEP_SHARE, STEP_BITS = 0.95, 30

_KIND = np.full(256, 2, np.int8)  # marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
CAPITALS, STEM = np.uint64(0xABCDEF12345), np.uint64(0x54321FEDCBA)
#: Bytes of a word's beginning that are a feature of their own.
STEM_BYTES = 5


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all runs of letters, digits or marks, and of beginnings of
    words; repeats included."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data, lower = np.frombuffer(joined, np.uint8), np.frombuffer(joined.lower(), np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate([[0], change])
    ends = np.append(change, len(kind))
    use = kind[starts] > 0
    starts, ends = starts[use], ends[use]
    place = (piece_hashes(lower, starts, ends) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, "right")
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    loud = (ends - starts >= 3) & (capitals[ends] - capitals[starts] == ends - starts)
    long = (ends - starts > STEM_BYTES) & (kind[starts] == 1)
    stems = (mix(piece_hashes(lower, starts[long], starts[long] + STEM_BYTES) + STEM) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    shape = int(mix(np.array([CAPITALS]))[0] >> np.uint64(64 - FEATURE_BITS))
    return np.concatenate([owner, owner[long], owner[loud]]), np.concatenate([place, stems, np.full(int(loud.sum()), shape)])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sgd_round(rows: list[tuple[np.ndarray, int]], weights: np.ndarray, thresholds: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One pass of stochastic gradient ascent on the log likelihood."""
    weights, thresholds = weights.copy(), thresholds.copy()
    top = len(thresholds)
    for x, grade in rows:
        step = rate / np.sqrt(max(len(x), 1))
        s = weights[x].sum()
        upper = _logistic(thresholds[grade] - s) if grade < top else 1.0
        lower = _logistic(thresholds[grade - 1] - s) if grade > 0 else 0.0
        p = max(upper - lower, 1e-9)
        weights[x] = weights[x] * (1 - DECAY) + step * (upper + lower - 1)
        if grade < top:
            thresholds[grade] += step * min(upper * (1 - upper) / p, 1.0)
        if grade > 0:
            thresholds[grade - 1] -= step * min(lower * (1 - lower) / p, 1.0)
        for k in range(1, top):  # ordered, with some room for each grade
            thresholds[k] = max(thresholds[k], thresholds[k - 1] + LEAST_GAP)
    return weights, thresholds


def telling(seen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which features (rows of texts by grade) tell grades apart well beyond chance, given each grade's share."""
    n = seen.sum(axis=1, keepdims=True)
    upper, above = n - np.cumsum(seen, axis=1)[:, :-1], 1 - np.cumsum(share)[:-1]
    z = np.abs(upper - n * above) / np.sqrt(n * above * (1 - above) + 1e-9)
    expected = np.maximum(n * share, 1e-9)
    g = 2 * (seen * np.log(np.maximum(seen, 1e-9) / expected)).sum(axis=1)
    return (n[:, 0] >= LEAST_TEXTS) & ((z.max(axis=1, initial=0) >= LEAST_Z) | (g >= LEAST_G))


def _packed(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ids of each text as gaps (the first from zero): their lower 16 bits and the rest."""
    gaps = np.diff(ids, prepend=0)
    gaps[starts] = ids[starts]
    return gaps.astype("<u2"), (gaps >> 16).astype(np.uint8)


def _unpacked(low: bytes, high: bytes, sizes: np.ndarray) -> np.ndarray:
    gaps = np.frombuffer(high, np.uint8).astype(np.int32) << 16
    gaps |= np.frombuffer(low, "<u2")
    sums = np.cumsum(gaps, dtype=np.int64)
    before = np.concatenate([np.zeros(1, np.int64), sums])[np.cumsum(sizes) - sizes]
    return (sums - np.repeat(before, sizes)).astype(np.int32)


_SHARD = "shard int, n int, grades binary, sizes binary, low binary, high binary"


def _shards(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """All rated texts as rows of about SHARD_ROWS of them, in an order that only the rows decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", HASH_SLICE):
            owner, place = features(batch.column(1).to_pylist())
            both = np.unique(owner << FEATURE_BITS | place)
            borders = np.searchsorted(both >> FEATURE_BITS, np.arange(batch.num_rows + 1))
            low, high = _packed(both & (1 << FEATURE_BITS) - 1, borders[:-1][np.diff(borders) > 0])
            columns = [pa.array([c[a:b].tobytes() for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())], pa.binary()) for c in (low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "low", "high"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
        if not rows:
            return
        rows.sort()
        rows = [rows[i] for i in np.random.RandomState(7).permutation(len(rows))]
        shard, _, low, high, grades = zip(*rows)
        sizes = np.array([len(x) for x in high], "<i4")
        held = [np.array(grades, np.int8).tobytes(), sizes.tobytes(), b"".join(low), b"".join(high)]
        yield pa.RecordBatch.from_arrays([pa.array([shard[0]], pa.int32()), pa.array([len(rows)], pa.int32()), *(pa.array([x], pa.binary()) for x in held)], names=["shard", "n", "grades", "sizes", "low", "high"])

    shards = max(SHARDS, -(-rated.count() // SHARD_ROWS))
    # the same join at every size: ratings that fit a broadcast today don't on larger tables
    chosen = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, low binary, high binary").join(rated.hint("shuffle_merge"), "doc_id")
    shard = F.pmod(F.xxhash64("doc_id", "low", "high"), F.lit(shards)).cast("int").alias("shard")
    dealt = chosen.select(shard, "doc_id", "low", "high", F.col("grade").cast("int").alias("grade")).repartitionById(shards, F.col("shard"))
    return written(dealt.mapInArrow(gather, _SHARD), "rated-shards")


def _texts_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each shard its grades, the features of all its texts end to end, and how many each has."""
    for n, grades, sizes, low, high in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("n", "grades", "sizes", "low", "high"))):
        sizes = np.frombuffer(sizes.as_py(), "<i4")
        yield np.frombuffer(grades.as_py(), np.int8), _unpacked(low.as_py(), high.as_py(), sizes), sizes


def _seen(shards: DataFrame, grades: int) -> np.ndarray:
    """Texts of each grade that hold each feature, by feature, in a last row all texts; over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(((1 << FEATURE_BITS) + 1) * grades, np.int64)
        for batch in batches:
            for own, x, sizes in _texts_of(batch):
                total += np.bincount(x * np.int64(grades) + np.repeat(own, sizes), minlength=len(total))
                total[-grades:] += np.bincount(own, minlength=grades)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(((1 << FEATURE_BITS) + 1) * grades)
    for at, n in shards.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # as many rows at most
        out[at] = n
    return out.reshape(-1, grades)


def _bound(probabilities: DataFrame) -> float | None:
    """The greatest step that KEEP_SHARE of all rows (column p) reach."""
    half = STEP_BITS // 2
    step = F.floor(F.col("p") * float(1 << STEP_BITS)).cast("long")
    steps = probabilities.select(F.shiftright(step, half).alias("upper"), step.bitwiseAND((1 << half) - 1).alias("lower"))
    upper = dict(steps.groupBy("upper").count().collect())  # 2 ** half + 1 rows
    need = int(np.ceil(KEEP_SHARE * sum(upper.values())))

    def reached(counts: dict[int, int], need: int) -> tuple[int, int]:
        for value in sorted(counts, reverse=True):
            if counts[value] >= need:
                return value, need
            need -= counts[value]
        raise ValueError("no rows")

    if not upper:
        return None
    high, need = reached(upper, need)
    low, _ = reached(dict(steps.where(F.col("upper") == high).groupBy("lower").count().collect()), need)
    return (high << half | low) / (1 << STEP_BITS)


def fit(docs: DataFrame, rated: DataFrame, grades: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and thresholds from all ratings (doc_id, grade) and their texts, and the
    probability of the top grade that KEEP_SHARE of its rated texts reach."""
    shards = _shards(docs, rated)
    seen = _seen(shards, grades)
    of_grade, seen = seen[-1], seen[:-1]
    total = int(of_grade.sum())
    weights = np.zeros(1 << FEATURE_BITS)
    below = np.cumsum(of_grade)[:-1] / max(total, 1)
    thresholds = np.maximum.accumulate(np.log((below + 1e-3) / (1 - below + 1e-3)))
    if not total:
        return weights, thresholds, 0.5
    keep = telling(seen, np.diff([0, *below, 1]))
    context = shards.sparkSession.sparkContext
    for number in range(ROUNDS):
        now = context.broadcast((weights, thresholds, keep))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, thresholds, kept = now.value
            moved, moved_thresholds = np.zeros(len(weights)), np.zeros(len(thresholds))
            for batch in batches:
                for own, x, sizes in _texts_of(batch):
                    use = kept[x]
                    ends = np.concatenate([[0], np.cumsum(use)])[np.cumsum(sizes)]
                    rows = list(zip(np.split(x[use], ends[:-1]), own.tolist()))
                    w, t = sgd_round(rows, weights, thresholds, RATE / np.sqrt(1 + number))
                    moved += len(rows) * (w - weights)
                    moved_thresholds += len(rows) * (t - thresholds)
            at = np.flatnonzero(moved)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, len(moved) + np.arange(len(thresholds))])), pa.array(np.concatenate([moved[at], moved_thresholds]))], names=["at", "moved"])

        both = np.concatenate([weights, thresholds])
        for at, moved in shards.mapInArrow(train, "at long, moved double").groupBy("at").agg(F.sum("moved")).collect():  # as many rows at most
            both[at] += moved / total
        both = both.round(12)  # the order of sums doesn't show
        weights, thresholds = both[: len(weights)], both[len(weights) :]
        now.unpersist()
    weights = np.where(np.abs(weights) > 1e-3, weights, 0.0)
    now = context.broadcast((weights, thresholds))

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = now.value
        for batch in batches:
            for own, x, sizes in _texts_of(batch):
                s = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[x], len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(1 - _logistic(t[-1] - s[own == grades - 1]))], names=["p"])

    least = _bound(written(shards.mapInArrow(probabilities, "p double"), "top-grade"))
    return weights, thresholds, 0.5 if least is None else least


def grade_of(quality: Column, toxic: Column) -> Column:
    """2: good text; 1: toxic wording in good text; 0: poor text; null unless both are rated."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(toxic == 0, 2)


def judge_quality(docs: DataFrame, rated: DataFrame, grades: int = 3, least: float | None = None) -> DataFrame:
    """doc_id, expected_grade, tail_prob, kept for every row of ``docs``.

    ``rated`` has doc_id and grade; rows without a grade or a matching text are left out.
    ``tail_prob`` is the probability of the top grade, and ``kept`` whether it is at least
    ``least``, or by default what KEEP_SHARE of the rated texts of that grade reach.  A text that is null or has no visible character has expected grade and
    probability 0 and isn't kept.  With no ratings all others get the same values.  Repeated
    rows count each; other columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marks = rated.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where(F.col("grade").between(0, grades - 1))
    weights, thresholds, reached = fit(narrow.where("text is not null"), marks, grades)
    least = reached if least is None else least
    model = docs.sparkSession.sparkContext.broadcast((weights, thresholds))  # 2 ** FEATURE_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = model.value
        for batch in text_slices(batches, "text", HASH_SLICE):
            n = batch.num_rows
            owner, place = features(batch.column(1).to_pylist())
            any_run = np.bincount(owner, minlength=n) > 0
            live = w[place] != 0
            both = np.unique(owner[live] << FEATURE_BITS | place[live])
            s = np.bincount(both >> FEATURE_BITS, w[both & (1 << FEATURE_BITS) - 1], n)
            above = 1 - _logistic(t[None, :] - s[:, None])  # P(grade > k)
            expected = np.where(any_run, above.sum(axis=1), 0.0)
            tail = np.where(any_run, above[:, -1], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(any_run & (tail >= least))], names=["doc_id", "expected_grade", "tail_prob", "kept"])

    return narrow.mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, kept boolean")
