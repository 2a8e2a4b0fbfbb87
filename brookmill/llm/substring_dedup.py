"""Operator 7: removing long repeated substrings with a prefix-free parse.

Rolling-hash triggers cut every text into phrases: a trigger is a place whose next
``TRIGGER_BYTES`` bytes hash below a bound, and a phrase runs from one trigger to the end of
the next one's bytes, so no phrase is a proper prefix of another, and equal stretches of text
are cut alike.  The parse is worked on instead of the bytes:

1. Phrases, the ``length``-byte strings that start at triggers (the parse suffixes, cut to
   that depth), and those strings with the phrase before them are grouped over the corpus.
   A string that holds a phrase which occurs once cannot repeat, which settles nearly all
   places of ordinary text.  If a suffix repeats with the phrase before it, so does every
   string that starts in that phrase, and one of the occurrences speaks for all.
2. What is left are the places near the ends of repeated stretches.  The strings that start
   there are grouped, together with those of one occurrence of each repeated phrase.
3. Places whose string occurs at least twice are joined into maximal runs and removed.

Suffixes are grouped by 64-bit fingerprints of their first ``length`` bytes, sorted within
buckets, in place of a full lexicographic suffix array: only equality to that depth decides.
Each slice of texts sends a string at most twice, however often it holds it, so that a
passage which a third of all texts share stays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, parallelism, text_slices, written
from .hashing import mix, prefix_sums, rolling_hashes, stretch_hashes

TRIGGER_BYTES = 24
#: Mean distance of triggers, at most this and a sixth of the string length: then few strings
#: hold no whole phrase.
PHRASE_BYTES, PHRASES = 64, 6
SLICE = 1 << 20
_PHRASE, _SUFFIX = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: The lowest bit of a key marks suffixes with the phrase before them in the first grouping,
#: and in the second strings that are known to repeat.
_MARK, _UNMARKED = np.uint64(1), ~np.uint64(1)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def _slices(docs: DataFrame) -> DataFrame:
    """Rows of about SLICE bytes of text: (batch, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(text_slices(batches, "text", SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array([(partition << 32) + number], pa.int64()), pa.array([_packed(batch)], pa.binary())], names=["batch", "data"])

    return docs.mapInArrow(giving_back(run), "batch long, data binary")


class Parse:
    """The texts of one slice end to end, with their triggers and the keys of both groupings."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        self.length = length
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        self.data = b"".join(texts)
        self.borders = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        n = len(self.data)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.h = prefix_sums(self.bytes)
        rolling = rolling_hashes(self.bytes, TRIGGER_BYTES) * np.uint64(0x9FB21C651E98DF25)
        triggers = np.flatnonzero(rolling < np.uint64((1 << 64) // max(min(PHRASE_BYTES, length // PHRASES), 1)))
        owner = np.searchsorted(self.borders, triggers, "right") - 1
        ends = self.borders[owner + 1]
        use = (triggers + TRIGGER_BYTES <= ends) & (ends - self.borders[owner] >= length)
        self.triggers, self.owner, self.ends = triggers[use], owner[use], ends[use]
        same = self.owner[1:] == self.owner[:-1]
        self.phrase_starts, self.phrase_ends = self.triggers[:-1][same], self.triggers[1:][same] + TRIGGER_BYTES
        full = self.triggers + length <= self.ends
        self.suffixes = self.triggers[full]
        same = self.owner[full][1:] == self.owner[full][:-1]
        self.lefts, self.rights = self.suffixes[:-1][same], self.suffixes[1:][same]

    def phrase_keys(self) -> np.ndarray:
        return mix(stretch_hashes(self.h, self.phrase_starts, self.phrase_ends) + _PHRASE) & _UNMARKED

    def suffix_keys(self) -> np.ndarray:
        return mix(stretch_hashes(self.h, self.suffixes, self.suffixes + self.length) + _SUFFIX) & _UNMARKED

    def joined_keys(self) -> np.ndarray:
        return mix(stretch_hashes(self.h, self.lefts, self.rights + self.length)) | _MARK

    def string_keys(self, starts: np.ndarray) -> np.ndarray:
        return mix(stretch_hashes(self.h, starts, starts + self.length)) & _UNMARKED

    def open_places(self, repeated: np.ndarray) -> np.ndarray:
        """Starts that the first grouping leaves open."""
        length, n = self.length, len(self.data)
        blocked = np.zeros(n + 2, np.int32)
        once = ~_among(self.phrase_keys(), repeated) & (self.phrase_ends - self.phrase_starts <= length)
        np.add.at(blocked, np.maximum(self.phrase_ends[once] - length, 0), 1)
        np.add.at(blocked, self.phrase_starts[once] + 1, -1)
        settled = _among(self.joined_keys(), repeated)
        np.add.at(blocked, self.lefts[settled], 1)
        np.add.at(blocked, self.rights[settled], -1)
        is_open = np.cumsum(blocked[:n]) == 0
        inside = np.zeros(n + 2, np.int32)
        for a, b in zip(self.borders[:-1].tolist(), self.borders[1:].tolist()):
            if b - a >= length:
                inside[a] += 1
                inside[b - length + 1] -= 1
        is_open &= np.cumsum(inside[:n]) > 0
        is_open[self.suffixes] = False
        return np.flatnonzero(is_open)

    def between(self, keys: np.ndarray, longer: int = 0) -> np.ndarray:
        """Starts strictly between two triggers whose joined key is among ``keys``."""
        use = _among(self.joined_keys(), keys) & (self.rights - self.lefts > max(longer, 1))
        first, count = self.lefts[use] + 1, self.rights[use] - self.lefts[use] - 1
        return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if use.any() else np.zeros(0, np.int64)

    def covered_starts(self, repeated: np.ndarray, strings: np.ndarray) -> np.ndarray:
        """Ascending starts whose strings repeat; those between two close ones may be left out."""
        places = self.open_places(repeated)
        found = [self.suffixes[_among(self.suffix_keys(), repeated)], places[_among(self.string_keys(places), strings)], self.between(repeated, self.length)]
        return np.unique(np.concatenate(found))


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if len(ordered) == 0:
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


_KEYED = "bucket int, batch long, keys binary"
_ANSWER = "batch long, keys binary, firsts binary"


def _keyed_rows(batch_id: int, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A slice's keys by bucket, each at most twice."""
    keys = np.sort(keys)
    if len(keys) > 2:
        keys = keys[np.concatenate([[True, True], keys[2:] != keys[:-2]])]
    borders = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    rows = np.flatnonzero(np.diff(borders)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([batch_id] * len(rows), pa.int64()), pa.array([keys[borders[b] : borders[b + 1]].tobytes() for b in rows], pa.binary())], names=["bucket", "batch", "keys"])


def _repeated(keyed: DataFrame, buckets: int, second: bool = False) -> DataFrame:
    """For each slice its keys that occur at least twice in the corpus (``keys``), and which
    of the joined ones it is the first slice to hold (``firsts``).

    In the second grouping a marked key makes its unmarked ones repeat, and only these are
    answered.
    """

    def group(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, "<u8") for _, k in rows])
        owner = np.repeat(np.arange(len(rows)), [len(k) // 8 for _, k in rows])
        order = np.argsort(keys, kind="stable")  # rows are in the order of slices
        keys, owner = keys[order], owner[order]
        same = (keys[1:] | _MARK) == (keys[:-1] | _MARK) if second else keys[1:] == keys[:-1]
        follows = np.concatenate([[False], same])
        again = follows | np.concatenate([same, [False]])
        if second:
            again &= (keys & _MARK) == 0
        first = ~follows[again] & ((keys[again] & _MARK) > 0)
        keys, owner = keys[again], owner[again]
        order = np.argsort(owner, kind="stable")
        keys, first, borders = keys[order], first[order], np.searchsorted(owner[order], np.arange(len(rows) + 1))
        found = [(rows[i][0], np.unique(keys[a:b]).tobytes(), keys[a:b][first[a:b]].tobytes()) for i, a, b in zip(range(len(rows)), borders[:-1].tolist(), borders[1:].tolist()) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.binary())], names=["batch", "keys", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for arrow in batches:
            for b, batch, keys in zip(*(c.to_pylist() for c in arrow.columns)):
                if b != bucket and held:
                    yield group(held)
                    held = []
                bucket = b
                held.append((batch, keys))
        if held:
            yield group(held)

    return keyed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "batch").mapInArrow(giving_back(run), _ANSWER)


def _with_answers(slices: DataFrame, answers: list[DataFrame], work, schema) -> DataFrame:
    """Brings each slice together with its answers; ``work(batch id, slice, answers)`` yields batches.

    The first answers' ``firsts`` come last.  The slices are shuffled by a plain join on their
    number, so that Spark writes them once for both uses.
    """
    rows, columns = slices, ["batch", "data"]
    for turn, found in enumerate(answers):
        gathered = [F.collect_list("keys").alias(f"keys{turn}")] + ([F.collect_list("firsts").alias("firsts")] if turn == 0 else [])
        rows = rows.join(found.groupBy("batch").agg(*gathered).hint("shuffle_merge"), "batch", "left")
        columns.append(f"keys{turn}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            for i in range(arrow.num_rows):
                blobs = [arrow.column(c)[i].as_py() or [] for c in range(2, arrow.num_columns)]
                known = [np.sort(np.frombuffer(b"".join(x), "<u8")) for x in blobs]
                yield from work(arrow.column(0)[i].as_py(), _unpacked(arrow.column(1)[i].as_py()), known)

    return rows.select(*columns, "firsts").mapInArrow(giving_back(run), schema)


def _runs(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs [a, b) covered by the strings of ``length`` bytes at ascending starts."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    return np.stack([starts[new], np.append(starts[new[1:] - 1], starts[-1]) + length], axis=1)


def _whole_characters(data: bytes, a: int, b: int, first: int, last: int) -> tuple[int, int]:
    """Shrinks a run to whole UTF-8 characters of the text [first, last)."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < last and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeats(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``, and ``carry``.

    Texts are UTF-8 bytes, a null text is empty.  Every byte that a ``length``-byte string
    covers which also starts anywhere else, in the same text or another, is removed; strings
    do not cross texts and are judged on the input, and all their occurrences go.
    ``n_spans`` counts maximal removed runs and ``kept_sha256`` digests the other bytes.  With
    ``with_text`` a column ``text`` follows: the text without its removed runs, each shrunk to
    whole characters (null stays null).  Rows that repeat are texts of their own; an empty
    table gives no rows; columns that are neither ``doc_id``, ``text`` nor carried are ignored.
    """
    buckets = 4 * parallelism(docs.sparkSession)
    names = [c for c in carry if c not in ("doc_id", "text")]
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *names)
    slices = written(_slices(narrow), "slices", gather=False)  # numbered by task

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            for i in range(arrow.num_rows):
                parse = Parse(_unpacked(arrow.column(1)[i].as_py()), length)
                yield _keyed_rows(arrow.column(0)[i].as_py(), np.concatenate([parse.phrase_keys(), parse.suffix_keys(), parse.joined_keys()]), buckets)

    def second_keys(batch: int, rows: pa.RecordBatch, answers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        parse = Parse(rows, length)
        repeated, firsts = answers
        spoken_for = parse.string_keys(parse.between(firsts)) | _MARK
        yield _keyed_rows(batch, np.concatenate([parse.string_keys(parse.open_places(repeated)), spoken_for]), buckets)

    first = written(_repeated(slices.mapInArrow(giving_back(first_keys), _KEYED), buckets), "repeated-phrases")
    second = _repeated(_with_answers(slices, [first], second_keys, _KEYED), buckets, second=True)

    def finish(batch: int, rows: pa.RecordBatch, answers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        parse = Parse(rows, length)
        starts = parse.covered_starts(answers[0], answers[1])
        owner = np.searchsorted(parse.borders, starts, "right") - 1
        cut = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        n_removed, n_spans, digests, texts = [], [], [], []
        nulls = rows.column(1).is_null().to_pylist()
        for i, (a, b) in enumerate(zip(parse.borders[:-1].tolist(), parse.borders[1:].tolist())):
            runs = _runs(starts[cut[i] : cut[i + 1]], length).tolist()
            edges = [a, *(x for run in runs for x in run), b]
            kept = b"".join(parse.data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
            n_removed.append(b - a - len(kept))
            n_spans.append(len(runs))
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                edges = [a, *(x for run in runs for x in _whole_characters(parse.data, *run, a, b)), b]
                texts.append(None if nulls[i] else b"".join(parse.data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)).decode("utf-8", "surrogatepass"))
        columns = [rows.column(0), pa.array(np.diff(parse.borders)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), *rows.columns[2:]]
        labels = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *names]
        if with_text:
            columns.append(pa.array(texts, pa.string()))
            labels.append("text")
        yield pa.RecordBatch.from_arrays(columns, names=labels)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += "".join(f", `{c}` {narrow.schema[c].dataType.simpleString()}" for c in names) + (", text string" if with_text else "")
    return _with_answers(slices, [first, second], finish, schema)
