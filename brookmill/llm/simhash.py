"""Operator 2: near duplicates by SimHash, joined over segment bit counts.

A 64-bit fingerprint is mapped to the bit counts of its segments.  One differing bit moves
the counts by one in one segment, so the Manhattan distance of two count vectors never
exceeds the Hamming distance of the fingerprints.  Count vectors are cells of a grid; each
fingerprint is sent to the cells within the radius (to half of them: a pair needs to meet
once), the cells are joined, and the fingerprints that meet are compared exactly.  Texts
with one fingerprint are one node of that join, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, text_slices, written
from .components import connected_components

SEED = 42
SEGMENTS = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text as an unsigned integer; zero if it has no word.

    A-Z is lower-cased, words are runs without ASCII white space, and shingles keep repeats.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):  # bounded memory for very long texts
        block = np.array(hashes[part : part + (1 << 16)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and its fingerprint ``fp`` as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=1 << 20):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(giving_back(run), "doc_id long, fp long")


def cell(fp: Column, segments: int = SEGMENTS) -> Column:
    """The bit counts of the segments as the digits of one number; two spare values below and above."""
    width = 64 // segments
    digit = (width + 5).bit_length()
    count = [F.bit_count(F.shiftrightunsigned(fp, s * width).bitwiseAND((1 << width) - 1)) + 2 for s in range(segments)]
    return sum((F.shiftleft(c.cast("bigint"), s * digit) for s, c in enumerate(count)), F.lit(0).cast("bigint"))


def half_ball(radius: int, segments: int = SEGMENTS) -> list[int]:
    """Differences of cells within a Manhattan radius: zero, and one of each pair d, -d."""
    digit = (64 // segments + 5).bit_length()

    def vectors(left: int, places: int):
        if not places:
            yield ()
            return
        for x in range(-left, left + 1):
            for rest in vectors(left - abs(x), places - 1):
                yield (x, *rest)

    return [sum(x << (s * digit) for s, x in enumerate(d)) for d in vectors(radius, segments) if next((x for x in d if x), 1) > 0]


def hamming_links(fps: DataFrame, radius: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) with at most ``radius`` differing bits."""
    if radius > 2:
        raise ValueError("cells leave room for a radius of 2")
    home = fps.select(F.col("fp").alias("b"), cell(F.col("fp"), segments).alias("cell"))
    step = F.explode(F.lit(half_ball(radius, segments)).cast("array<bigint>"))
    probes = fps.select(F.col("fp").alias("a"), cell(F.col("fp"), segments).alias("own"), step.alias("step"))
    probes = probes.select("a", "step", (F.col("own") + F.col("step")).alias("cell"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & ((F.col("step") != 0) | (F.col("a") < F.col("b")))
    return probes.join(home.hint("shuffle_hash"), (probes["cell"] == home["cell"]) & near).select("a", "b")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    A null text counts as empty; texts without words share the fingerprint zero and are linked
    like any others.  Rows of equal id each get a row.  A row with a null id gets the group's
    smallest id, which is null if no member has one.  Other columns are ignored, and an empty
    table gives no rows.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(hamming_links(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(groups, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
