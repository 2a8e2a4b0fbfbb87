"""Operator 9: token ids in files with Elias-Fano encoded document boundaries.

A file is a sequence of segments.  A segment holds the ids of consecutive documents,
concatenated as little-endian unsigned integers, and the ends of its documents as an
Elias-Fano code: with n ends below u, each end keeps its low floor(log2(u/n)) bits in a
packed array, and its high part as a one in a bit array after as many zeros.  That takes
at most 2 + log2(u/n) bits a document, and positions of every ``SELECT_STEP``-th one make
the i-th end a lookup and a short scan.  Segments are rows of a Parquet table, so that any
store Spark can write to will do and a lost task leaves nothing half written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_table_path, parallelism, text_slices
from .tokens import TEXT_SLICE, encoder

SELECT_STEP = 256
#: A segment is closed when it holds so many ids or documents; one document is never cut.
SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 16

SEGMENT_SCHEMA = (
    "shard int, segment int, id_bytes int, first long, n_ids long, doc_ids array<bigint>, "
    "low_bits int, low binary, high binary, selects binary, ids binary"
)


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Codes a non-decreasing array of n ends: (low bit count, low bits, high bits, select samples)."""
    n = len(ends)
    if n == 0:
        return 0, b"", b"", b""
    ends = ends.astype(np.uint64)
    low_bits = max(0, int(int(ends[-1]) // n).bit_length() - 1)
    bits = ((ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    return low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SELECT_STEP].astype("<u4").tobytes()


class EliasFano:
    """Reads the code back: single ends by ``select``, or all of them."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, selects: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.selects = np.frombuffer(selects, "<u4")

    def _low(self, i: int) -> int:
        first, value = i * self.low_bits, 0
        for b in range(self.low_bits):
            value |= int(self.low[(first + b) >> 3] >> ((first + b) & 7) & 1) << b
        return value

    def select(self, i: int) -> int:
        """The i-th end, from 0."""
        left, start = i % SELECT_STEP, int(self.selects[i // SELECT_STEP])
        byte = start >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + SELECT_STEP], bitorder="little")) + 8 * byte
        ones = ones[ones >= start]
        while len(ones) <= left:  # a long gap of zeros
            byte += SELECT_STEP
            ones = np.append(ones, np.flatnonzero(np.unpackbits(self.high[byte : byte + SELECT_STEP], bitorder="little")) + 8 * byte)
        return ((int(ones[left]) - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1)


def sharded_by_id(docs: DataFrame, shards: int) -> DataFrame:
    """Deals rows to ``shards`` ranges of ascending ids.

    The borders are quantiles of the id column, which is all that their pass reads.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10_000)).first()[0] if shards > 1 else []
    borders = sorted(set(cuts or []))
    shard = F.lit(0)
    if borders:
        shard = F.coalesce(F.size(F.filter(F.lit(borders).cast("array<bigint>"), lambda b: b < F.col("doc_id"))), F.lit(0))
    return docs.withColumn("shard", shard).repartitionById(len(borders) + 1, F.col("shard"))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encodes every text, appends ``end_id`` and writes the files in ascending ``doc_id`` order.

    ``docs`` needs ``doc_id`` and ``text``; a null text counts as empty, rows of equal id are
    ordered by text, a null id comes first, and other columns are ignored.  An empty table
    gives files without segments.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = sharded_by_id(narrow, shards or parallelism(docs.sparkSession)).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, True)
        width = np.dtype(enc.dtype).itemsize
        state = {"shard": None, "segment": 0, "first": 0}
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def segment() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
            low_bits, low, high, selects = elias_fano(ends)
            row = {"shard": state["shard"], "segment": state["segment"], "id_bytes": width, "first": state["first"], "n_ids": int(ends[-1]), "doc_ids": list(doc_ids), "low_bits": low_bits, "low": low, "high": high, "selects": selects, "ids": np.concatenate(ids).tobytes()}
            state["segment"] += 1
            state["first"] += int(ends[-1])
            ids.clear()
            doc_ids.clear()
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT_ARROW)

        held = 0
        for batch in text_slices(batches, most=TEXT_SLICE):
            shard_of = batch.column(2).to_pylist()
            encoded, ends = enc.encode(batch.column(1), end_id)
            for doc_id, shard, a, b in zip(batch.column(0).to_pylist(), shard_of, ends[:-1].tolist(), ends[1:].tolist()):
                if ids and (shard != state["shard"] or held >= SEGMENT_IDS or len(ids) >= SEGMENT_DOCS):
                    yield segment()
                    held = 0
                if shard != state["shard"]:
                    state.update(shard=shard, segment=0, first=0)
                ids.append(encoded[a:b])
                doc_ids.append(doc_id)
                held += b - a
        if ids:
            yield segment()

    ordered.select("doc_id", "text", "shard").mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


SEGMENT_ARROW = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("id_bytes", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
    ("selects", pa.binary()), ("ids", pa.binary()),
])


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it.  A shard knows where its segments
    begin, so only one total per shard is gathered.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = dict(segments.groupBy("shard").agg(F.sum("n_ids")).collect())  # one row a shard
    bases, base = {}, 0
    for shard in sorted(totals):
        bases[shard] = base
        base += totals[shard]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["doc_ids"])
                ends = EliasFano(n, row["low_bits"], row["low"], row["high"], row["selects"]).all()
                starts = np.concatenate([[0], ends[:-1]])
                wide = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                crcs = [zlib.crc32(wide[a:b].data) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"] + bases[row["shard"]], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` (into the shared folder by default) and reads them back."""
    spark = docs.sparkSession
    path = path or new_table_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(spark, path)
