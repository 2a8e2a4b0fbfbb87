"""Operator 3: language identification by nearest centroid.

A text becomes counts of byte trigrams over its letters, hashed to ``DIMS`` places, damped,
weighted by inverse document frequency and scaled to length one.  Each language has several
centroids, found by spherical k-means over all its labelled texts; document frequencies and
bounds come from all training texts too.  A text takes the language of the centroid with the
greatest cosine.  It is rejected if that cosine is below a share of what nearly all training
texts reach that hold about as many different trigrams: short and repetitive texts are held
against their like.

The texts are counted once into a table of slices, each a row.  Every round of the k-means
reads it; a task returns a sum for each centroid that it met, and tasks are as many as cores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, fold_of, from_planes, giving_back, planes, text_slices, written

DIMS = 4096
#: Centroids a language, k-means rounds.
CENTROIDS, ROUNDS = 4, 12
#: A best cosine is a rejection below this share of this quantile of the training texts' cosines,
#: in classes of texts by the logarithm of their different trigrams; classes of fewer texts
#: than LEAST_CLASS use the next lower one's bound, or have none.
REJECT_SHARE, LOW_QUANTILE, LEAST_CLASS = 0.4, 0.01, 20
#: Cosines are counted for that quantile in steps of one by this.
STEPS = 1 << 16
UNKNOWN = "und"
_SLICE, _ROWS = 1 << 18, 128

_AS_LETTER = np.full(256, 32, np.uint8)
_AS_LETTER[97:123] = np.arange(97, 123)
_AS_LETTER[128:] = np.arange(128, 256)


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Texts by DIMS counts of lower-cased byte trigrams; what isn't a letter counts as a space."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = _AS_LETTER[np.frombuffer(b"  ".join([b"", *raw, b""]), np.uint8)].astype(np.uint32)
    grams = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    place = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)
    blank = (data[1:-1] == 32) & ((data[:-2] == 32) | (data[2:] == 32))
    starts = np.cumsum([2] + [len(r) + 2 for r in raw])[:-1]
    owner = np.repeat(np.arange(-1, len(texts)), np.diff(np.concatenate([[0], np.maximum(starts - 1, 0), [len(place)]])))
    use = ~blank & (owner >= 0)
    return np.bincount(owner[use] * DIMS + place[use], minlength=len(texts) * DIMS)[: len(texts) * DIMS].reshape(len(texts), DIMS)


def size_class(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the number of different trigrams of each text."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each place, over all rows, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in text_slices(batches, "text", _SLICE, _ROWS):
            total[:DIMS] += (trigram_counts(batch.column(0).to_pylist()) > 0).sum(axis=0)
            total[DIMS] += batch.num_rows
        if total[DIMS]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], names=["place", "n"])

    found = docs.select("text").mapInArrow(giving_back(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    total = np.zeros(DIMS + 1, np.int64)
    for place, n in found.collect():  # DIMS + 1 rows
        total[place] = n
    return total[:DIMS], int(total[DIMS])


_SLICES = "langs binary, marks binary, held binary, counts binary"
_SUMS = "lang int, centroid int, total binary"
_PICKS = "lang int, cosine double, mark long, vector binary"


def _slices(training: DataFrame, langs: list[str]) -> DataFrame:
    """All texts, many to a row: numbers of their languages, hashes, which places they hold and how often."""
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", _SLICE, _ROWS):
            counts = trigram_counts(batch.column(0).to_pylist())
            own = np.array([number[lang] for lang in batch.column(1).to_pylist()], "<i4")
            held = np.packbits(counts > 0, axis=1, bitorder="little")
            cells = own.tobytes(), batch.column(2).to_numpy().astype("<i8").tobytes(), held.tobytes(), planes(counts[counts > 0].astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["langs", "marks", "held", "counts"])

    return written(training.select("text", "lang", F.xxhash64("text").alias("mark")).mapInArrow(giving_back(run), _SLICES), "trigram-counts")


def _vectors_of(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice the languages, hashes, size classes and vectors of its texts."""
    for batch in batches:
        for langs, marks, held, counts in zip(*(c.to_pylist() for c in batch.columns)):
            held = np.unpackbits(np.frombuffer(held, np.uint8).reshape(-1, DIMS // 8), axis=1, bitorder="little").view(bool)
            dense = np.zeros(held.shape, np.uint32)
            dense[held] = from_planes(counts, "<u4")
            yield np.frombuffer(langs, "<i4"), np.frombuffer(marks, "<i8"), size_class(dense), tf_idf(dense, idf)


def _by_language(slices: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A language, and hashes and vectors of its texts; texts without letters say nothing."""
    for langs, marks, _, x in slices:
        lettered = np.einsum("ij,ij->i", x, x) > 0.5
        for lang in np.unique(langs[lettered]).tolist():
            use = lettered & (langs == lang)
            yield lang, marks[use], x[use]


def _sums(slices: DataFrame, idf: np.ndarray, centroids: dict[int, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """For each language and centroid the sum of the texts' vectors nearest to it; all texts of a language go to its only one."""
    now = slices.sparkSession.sparkContext.broadcast((idf, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = now.value
        totals: dict[tuple[int, int], np.ndarray] = {}
        for lang, _, x in _by_language(_vectors_of(batches, idf)):
            own = (x @ centroids[lang].T).argmax(axis=1) if lang in centroids else np.zeros(len(x), int)
            for i in np.unique(own).tolist():
                totals[lang, i] = totals.get((lang, i), 0) + x[own == i].sum(axis=0, dtype=float)
        yield from _rows_of(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lang, i, total in zip(*(c.to_pylist() for c in batch.columns)):
                totals[lang, i] = totals.get((lang, i), 0) + np.frombuffer(total, "<f8")
        yield from _rows_of(totals)

    found = few_files(slices).mapInArrow(giving_back(run), _SUMS).repartition("lang", "centroid").mapInArrow(add, _SUMS)
    return {(r["lang"], r["centroid"]): np.frombuffer(r["total"], "<f8") for r in found.collect()}  # CENTROIDS a language


def _rows_of(totals: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (lang, i), total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int32()), pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lang", "centroid", "total"])


def _picked(slices: DataFrame, idf: np.ndarray, toward: dict[int, np.ndarray], chosen: dict[int, set[int]], sign: int) -> dict[int, tuple[int, np.ndarray]]:
    """Of each language the text, none of the chosen, whose greatest cosine with the vectors ``toward`` is
    the least (sign 1) or the greatest (sign -1); of equal ones that with the least hash."""
    now = slices.sparkSession.sparkContext.broadcast((idf, toward, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, toward, chosen = now.value
        best: dict[int, tuple[float, int, bytes]] = {}
        for lang, marks, x in _by_language(_vectors_of(batches, idf)):
            cosine = np.round(sign * (x.astype(float) @ toward[lang].astype(float).T).max(axis=1), 9)
            for at in np.lexsort((marks, cosine)).tolist():
                if int(marks[at]) not in chosen[lang]:
                    found = (float(cosine[at]), int(marks[at]), x[at].astype("<f4").tobytes())
                    best[lang] = min(best.get(lang, found), found)
                    break
        for lang, found in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((lang, *found), (pa.int32(), pa.float64(), pa.int64(), pa.binary()))], names=["lang", "cosine", "mark", "vector"])

    rows = few_files(slices).mapInArrow(giving_back(run), _PICKS).groupBy("lang").agg(F.min(F.struct("cosine", "mark", "vector")).alias("best")).collect()
    return {r["lang"]: (r["best"]["mark"], np.frombuffer(r["best"]["vector"], "<f4")) for r in rows}


def clustered_centroids(slices: DataFrame, idf: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Of each language the centroids by spherical k-means over all its texts, started from the texts
    farthest from one another, the first of them nearest to the mean.  Fewer than ``k`` if it has fewer different texts."""
    toward = {lang: total[None] for (lang, _), total in _sums(slices, idf, {}).items()}
    chosen: dict[int, set[int]] = {lang: set() for lang in toward}
    centroids: dict[int, np.ndarray] = {}
    for number in range(k):
        for lang, (mark, vector) in _picked(slices, idf, toward if number == 0 else centroids, chosen, -1 if number == 0 else 1).items():
            chosen[lang].add(mark)
            centroids[lang] = np.stack([*centroids.get(lang, ()), vector])
    for _ in range(rounds):
        before = centroids
        centroids = {lang: c.copy() for lang, c in before.items()}
        for (lang, i), total in _sums(slices, idf, before).items():
            centroids[lang][i] = total / max(np.linalg.norm(total), 1e-12)
        if all(np.array_equal(c, before[lang]) for lang, c in centroids.items()):
            break  # further rounds change nothing
    return centroids


def fit(training: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(idf, language of each centroid, centroids, least cosine of each size class), all from all of ``training`` (text, lang)."""
    seen, n = document_frequency(training)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    langs = sorted(r["lang"] for r in training.select("lang").distinct().collect())
    slices = _slices(training, langs)
    rows = sorted((langs[lang], c.astype("<f4").tobytes()) for lang, found in clustered_centroids(slices, idf).items() for c in found)
    matrix = np.frombuffer(b"".join(c for _, c in rows), "<f4").reshape(len(rows), DIMS)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, size, x in _vectors_of(batches, idf):
            step = np.round((x @ matrix.T).max(axis=1, initial=0).astype(float) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(step)], names=["size", "step"])

    counted = slices.mapInArrow(giving_back(cosines), "size long, step long").where("step > 0").groupBy("size", "step").count()
    low = counted.groupBy("size").agg(F.percentile("step", F.lit(LOW_QUANTILE), F.col("count")).alias("low"), F.sum("count").alias("n"))
    found = {r["size"]: r for r in low.collect()}  # 13 rows
    bounds = np.zeros(DIMS.bit_length())
    for size in range(len(bounds)):
        enough = size in found and found[size]["n"] >= LEAST_CLASS
        bounds[size] = REJECT_SHARE * found[size]["low"] / STEPS if enough else bounds[size - 1] if size else 0.0
    return idf, [lang for lang, _ in rows], matrix, bounds


def predict_language(docs: DataFrame, folds: int = 4, held_out: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, and its ``carry`` columns.

    Learns from rows with a lang whose fold, crc32 of the id as text modulo ``folds``, isn't
    ``held_out``.  ``score`` is the cosine with the nearest centroid.  A text that is null or
    has no letter (str.isalpha) is ``und`` with score 0, and rejected; if no row can be learned
    from, all are.
    Rows with a null id are never held out; repeated rows count each; other columns are
    ignored; an empty table gives no rows.
    """
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", held.alias("held_out"))
    others = [c for c in carry if c != "text"]  # a text that is carried goes to the tasks once
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col("text").alias("_text"), *others)
    idf, langs, matrix, bounds = fit(narrow.where("not held_out and lang is not null and text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text", _SLICE, _ROWS):
            texts = batch.column(2).to_pylist()
            lettered = np.array([has_letter(t) for t in texts], bool)
            if langs:
                counts = trigram_counts(texts)
                cosines = tf_idf(counts, idf) @ matrix.T
                best = cosines.argmax(axis=1)
                score = np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0.0).astype(float)
                rejected = ~lettered | (score < bounds[size_class(counts)])
                names = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
            else:
                score, rejected, names = np.zeros(len(texts)), np.ones(len(texts), bool), [UNKNOWN] * len(texts)
            carried = [batch.column(2 if c == "text" else 3 + others.index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected), *carried], names=["doc_id", "held_out", "lang_pred", "score", "rejected", *carry])

    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(giving_back(run), schema + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry))
