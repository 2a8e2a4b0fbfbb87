"""Operator 8: language-model scores from a log-frequency Bloom filter.

Training counts of single tokens and of pairs are quantised to levels, two for each doubling
(1, 2, 3, 4, 6, 8, 12 ...).  For a token or pair of level q the filter holds the q keys
(n-gram, 1) ... (n-gram, q); a count is read by probing levels upwards until one is missing,
so a false answer can only raise a count, and rarely by more than one level.  The filter has
``BITS_PER_KEY`` bits for every key that it holds, bucket by bucket, so that the share of
false answers is the same for any corpus.  Up to ``BROADCAST_BITS`` it is broadcast; a larger
one stays in its buckets, and the keys of each group of texts are probed there, with the same
answers.  A group has about ``ASKED`` tokens and asks each bucket at most once, so the questions
are few; they and the counts travel as gaps between sorted keys, byte by byte, and what a bucket
answers comes back to the group's tokens.

A token's probability is PAIR_WEIGHT of its pair's share of the history's count and the rest of
the token's smoothed share of the corpus; after a history that was never seen it is the smoothed
share alone.  Counts of pairs and of predicted tokens are read as the least of their level, the history's
as the greatest of its level, and exactly for frequent words.  So the probabilities of all known tokens
and one unknown token sum to no more than one, save for false answers, to one where counts are below five
or exact, and to 1 - PAIR_WEIGHT / 2 at the least.

N-grams travel as 64-bit hashes in sorted arrays, one for each bucket and task, not as rows.
Exact token counts for the base score need no broadcast of the vocabulary: a bounded set of
frequent words is broadcast, and all other words of each batch are looked up in the bucket
tasks that hold their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropping_shuffles, fold_of, from_planes, giving_back, parallelism, planes, small_batches, text_slices, written
from .hashing import mix, pair_hash, words_of

#: Bits of the filter for each key, and hash functions of a key: about 2 % of keys that are not
#: held read as held.
BITS_PER_KEY, PROBES = 10, 3
#: The least count of each level from 1; the greatest is one below the next.
LEAST = np.array([1, *sorted([1 << i for i in range(1, 40)] + [3 << i for i in range(39)])], np.int64)
TOP_LEVEL = len(LEAST)
#: Bits of the largest filter that is broadcast.
BROADCAST_BITS = 1 << 30
#: Frequent words that are broadcast with their exact counts.
HEAD_WORDS = 1 << 16
#: Share of the pair's own estimate.
PAIR_WEIGHT = 0.6
END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text handled at a time.
TEXT_SLICE = 1 << 20
#: N-grams that a training task gathers before it hands them on.
GATHERED = 1_500_000
#: Tokens of the texts that ask the buckets together; keys and texts that a bucket answers at once.
ASKED, ANSWERED = 1_500_000, 1 << 18

_COUNTED = "bucket int, kind string, keys binary, counts binary"


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and ends, each one's text number, and each one's history."""
    words, text = words_of(texts)
    ends = np.searchsorted(text, np.arange(len(texts)), "right") + np.arange(len(texts))
    tokens = np.empty(len(words) + len(texts), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = END, words
    owner = np.empty(len(tokens), np.int64)
    owner[is_end], owner[~is_end] = np.arange(len(texts)), text
    return tokens, owner, np.concatenate([[END], tokens[:-1]])


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Different keys in order; by sorting, which is many times faster here than numpy's own way with a hash table."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _gaps(keys: np.ndarray) -> bytes:
    """Ascending keys as the planes of the first one and of the gaps between them."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(gaps: bytes) -> np.ndarray:
    return np.cumsum(from_planes(gaps, "<u8"), dtype=np.uint64)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _count(docs: DataFrame, buckets: int) -> DataFrame:
    """Sorted arrays of n-grams with their counts, for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"1": [], "2": []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, arrays in held.items():
                if not arrays:
                    continue
                keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
                arrays.clear()
                borders = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))  # buckets are ranges of keys
                rows = [b for b in range(buckets) if borders[b] < borders[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int32()), pa.array([kind] * len(rows)), pa.array([_gaps(keys[borders[b] : borders[b + 1]]) for b in rows], pa.binary()), pa.array([planes(counts[borders[b] : borders[b + 1]].astype("<u4")) for b in rows], pa.binary())],
                    names=["bucket", "kind", "keys", "counts"],
                )

        for batch in text_slices(batches, "text", TEXT_SLICE):
            tokens, _, history = _tokens([t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()])
            held["1"].append(tokens)
            held["2"].append(pair_hash(history, tokens))
            if sum(map(len, held["1"])) >= GATHERED:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(giving_back(run), _COUNTED)


class FrequencyFilter:
    """Bits of all buckets end to end; each bucket's task sets its own part."""

    def __init__(self, parts: list[np.ndarray]):
        self.bits = np.concatenate([*parts, np.zeros(1, np.uint8)])
        self.share = np.array([8 * len(p) for p in parts], np.int64)
        self.base = np.cumsum(self.share) - self.share

    @staticmethod
    def places(keys: np.ndarray, level: int, probe: int, share: np.ndarray | int) -> np.ndarray:
        """Bit numbers within the bucket."""
        mixed = mix(keys + np.uint64((level << 8 | probe) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return ((mixed >> np.uint64(32)) * np.asarray(share, np.uint64) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def part(cls, keys: np.ndarray, counts: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> np.ndarray:
        """The bits of one bucket, sized for what it holds."""
        levels = np.searchsorted(LEAST, counts, "right")
        share = max(-(-int(levels.sum()) * bits_per_key // 8), 1) * 8
        on = np.zeros(share, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            chosen = keys[levels >= level]
            for probe in range(PROBES):
                on[cls.places(chosen, level, probe, share)] = True
        return np.packbits(on, bitorder="little")

    def levels(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The level of each key by probing upwards in its bucket; 0 if it isn't held."""
        out = np.zeros(len(keys), np.int8)
        alive = np.arange(len(keys))
        base, share = self.base[bucket], self.share[bucket]
        for level in range(1, TOP_LEVEL + 1):
            for probe in range(PROBES):
                at = base[alive] + self.places(keys[alive], level, probe, share[alive])
                alive = alive[((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0) & (share[alive] > 0)]
            if not len(alive):
                break
            out[alive] = level
        return out


#: The least and the greatest count of a level, 0 standing for counts of none.
AT_LEAST = np.concatenate([[0.0], LEAST])
AT_MOST = np.concatenate([[0.0], LEAST[1:] - 1.0, [2.0 * LEAST[-1]]])


def _log_probabilities(tokens: np.ndarray, history: np.ndarray, level_of, n: int, v: int, exact: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of each token's probability after its history; ``level_of`` takes different keys in order.

    ``exact`` has the ascending keys of frequent words, and their counts.
    """
    unique, back = np.unique(np.concatenate([tokens, history]), return_inverse=True)
    least, most = _counts(unique, level_of(unique), exact)
    pairs, of_pair = np.unique(pair_hash(history, tokens), return_inverse=True)
    return _logs(least[back[: len(tokens)]], most[back[len(tokens) :]], AT_LEAST[level_of(pairs)][of_pair], n, v)


def _log_probabilities_of(words: np.ndarray, at: np.ndarray, word_levels: np.ndarray, levels: np.ndarray, n: int, v: int, exact: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The same for the texts of a group: its different words in order, each token's number among them,
    and the levels of all words that ``exact`` hasn't and of all pairs, each by ascending key."""
    end = np.searchsorted(words, END)
    before = np.concatenate([[end], at[:-1]])
    of_pair = np.unique(pair_hash(words[before], words[at]), return_inverse=True)[1]
    of_word = np.zeros(len(words), np.int8)
    of_word[~np.isin(words, exact[0], assume_unique=True)] = word_levels
    least, most = _counts(words, of_word, exact)
    return _logs(least[at], most[before], AT_LEAST[levels][of_pair], n, v)


def _counts(words: np.ndarray, levels: np.ndarray, exact: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest count that each word may have."""
    least, most = AT_LEAST[levels], AT_MOST[levels]
    if len(exact[0]):
        at = np.minimum(np.searchsorted(exact[0], words), len(exact[0]) - 1)
        known = exact[0][at] == words
        least[known] = most[known] = exact[1][at[known]]
    return least, most


def _logs(c1: np.ndarray, c0: np.ndarray, c2: np.ndarray, n: int, v: int) -> np.ndarray:
    """From the counts of each token, its history and their pair."""
    share = (np.minimum(c1, n) + 1) / (n + v + 1)
    p = np.where(c0 > 0, PAIR_WEIGHT * np.minimum(c2, c0) / np.maximum(c0, 1) + (1 - PAIR_WEIGHT) * share, share)
    return np.log10(np.minimum(p, 1.0))


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Each bucket that ascending keys are in, and where."""
    borders = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(borders)).tolist():
        yield b, slice(borders[b], borders[b + 1])


_MERGED = "bucket int, total long, distinct long, head_keys binary, head_counts binary, keys binary, counts binary, part binary"


def _merge(counted: DataFrame, buckets: int, bits_per_key: int) -> DataFrame:
    """One row for each bucket: its exact token counts, its most frequent words, its part of the filter."""
    head = -(-HEAD_WORDS // buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, {"1": [], "2": []}

        def merged_row() -> pa.RecordBatch:
            both = {}
            for kind, parts in held.items():
                both[kind] = _merged(np.concatenate([_keys(k) for k, _ in parts] or [np.zeros(0, np.uint64)]), np.concatenate([from_planes(c, "<u4") for _, c in parts] or [np.zeros(0, np.uint32)]).astype(np.int64))
                parts.clear()
            keys, counts = both["1"]
            top = np.sort(np.argsort(-counts, kind="stable")[:head])
            part = FrequencyFilter.part(np.concatenate([keys, both["2"][0]]), np.concatenate([counts, both["2"][1]]), bits_per_key)
            row = {"bucket": bucket, "total": int(counts.sum()), "distinct": len(keys), "head_keys": keys[top].tobytes(), "head_counts": counts[top].tobytes(), "keys": keys.tobytes(), "counts": counts.tobytes(), "part": part.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=_MERGED_ARROW)

        for batch in batches:
            for b, kind, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and bucket is not None:
                    yield merged_row()
                bucket = b
                held[kind].append((keys, counts))
        if bucket is not None:
            yield merged_row()

    dealt = counted.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(giving_back(run), _MERGED)


_MERGED_ARROW = pa.schema([("bucket", pa.int32()), ("total", pa.int64()), ("distinct", pa.int64()), *((c, pa.binary()) for c in ("head_keys", "head_counts", "keys", "counts", "part"))])

_DOCS_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]))
_DOCS = "array<struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>>"
#: A row of a group has its texts and the tokens that are still open, as numbers of its words: those
#: whose words aren't broadcast, with their text's number, or all tokens where the filter isn't
#: broadcast.  Every other row is what the group asks one bucket: counts of words, levels of pairs.
_SCORED = f"batch long, bucket int, docs {_DOCS}, words binary, tokens binary, texts binary, keys binary, pairs binary"
_SCORED_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("docs", _DOCS_ARROW), *((c, pa.binary()) for c in ("words", "tokens", "texts", "keys", "pairs"))])
_ANSWER = f"batch long, bucket int, docs {_DOCS}, words binary, tokens binary, texts binary, counts binary, word_levels binary, levels binary"
_ANSWER_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("docs", _DOCS_ARROW), *((c, pa.binary()) for c in ("words", "tokens", "texts", "counts", "word_levels", "levels"))])


def _answers(asked: list[tuple], keys: np.ndarray, counts: np.ndarray, filter_: FrequencyFilter | None) -> pa.RecordBatch:
    """What one bucket says to rows (batch, bucket, words, pairs), all looked up together."""

    def all_of(column: int) -> tuple[np.ndarray, list[slice]]:
        arrays = [np.zeros(0, np.uint64) if row[column] is None else _keys(row[column]) for row in asked]
        ends = np.cumsum([0] + [len(x) for x in arrays]).tolist()
        return np.concatenate(arrays), [slice(*x) for x in zip(ends, ends[1:])]

    (words, of_words), (pairs, of_pairs) = all_of(2), all_of(3)
    found = np.zeros(len(words), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        found = np.where(keys[at] == words, counts[at], 0)
    levels = [np.zeros(len(x), np.int8) if filter_ is None else filter_.levels(x, np.zeros(len(x), int)) for x in (words, pairs)]
    columns = [[planes(found[x]) for x in of_words], [levels[0][x].tobytes() for x in of_words], [levels[1][x].tobytes() for x in of_pairs]]
    none = [pa.nulls(len(asked), kind) for kind in (_DOCS_ARROW, pa.binary(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([row[0] for row in asked], pa.int64()), pa.array([row[1] for row in asked], pa.int32()), *none, *(pa.array(c, pa.binary()) for c in columns)], schema=_ANSWER_ARROW)


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, bits_per_key: int = BITS_PER_KEY, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    The model learns from documents whose fold, crc32 of the id as text modulo ``folds``, is
    not ``held_out``; a row with a null id counts as learned from.  A null or empty text is
    one end token.  Rows that repeat an id are scored each on its own.  If nothing is learned
    from, all counts are zero.  Other columns are ignored; an empty table gives no rows.
    A filter of more than ``broadcast_bits`` bits is probed where it lies.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 2 * parallelism(spark)
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held)
    with dropping_shuffles(spark):
        merged = written(_merge(_count(rows.where("not held_out"), buckets), buckets, bits_per_key), "ngram-counts")
    n, v, filter_bytes = (x or 0 for x in merged.agg(F.sum("total"), F.sum("distinct"), F.sum(F.octet_length("part"))).first())
    sharded = 8 * filter_bytes > broadcast_bits
    parts = [np.zeros(0, np.uint8)] * buckets
    heads = []
    for r in merged.select("bucket", "head_keys", "head_counts", *([] if sharded else ["part"])).toLocalIterator():
        heads.append((np.frombuffer(r["head_keys"], "<u8"), np.frombuffer(r["head_counts"], "<i8")))
        if not sharded:
            parts[r["bucket"]] = np.frombuffer(r["part"], np.uint8)
    head_keys = np.concatenate([k for k, _ in heads] or [np.zeros(0, np.uint64)])
    order = np.argsort(head_keys)
    head_keys, head_counts = head_keys[order], np.concatenate([c for _, c in heads] or [np.zeros(0, np.int64)])[order]
    # at most broadcast_bits / 8 bytes and HEAD_WORDS pairs
    model = spark.sparkContext.broadcast((None if sharded else FrequencyFilter(parts), head_keys, head_counts))
    parts.clear()
    base_log = float(np.log10(n + v + 1))
    slice_bytes, ask_at = TEXT_SLICE, ASKED

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, keys_of_head, counts_of_head = model.value
        partition = TaskContext.get().partitionId()
        number, n_held = 0, 0
        about: list[dict] = []
        flow: list[tuple[np.ndarray, np.ndarray]] = []  # of each slice: the words of its open tokens, and each one's number among them
        texts_of: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        pairs: list[np.ndarray] = []

        def ask() -> pa.RecordBatch:
            """A row for the texts, and one for each bucket that holds what they have to know."""
            words, place = np.unique(np.concatenate([w for w, _ in flow]), return_inverse=True)
            begin = np.cumsum([0] + [len(w) for w, _ in flow]).tolist()
            tokens = np.concatenate([place[i:j][at] for i, j, (_, at) in zip(begin, begin[1:], flow)])
            own = {"batch": batch_id, "docs": about, "words": _gaps(words), "tokens": planes(tokens.astype("<u4")), "texts": None if sharded else planes(np.concatenate(texts_of).astype("<u4"))}
            rows: dict[int, dict] = {}
            for name, arrays in (("keys", keys), ("pairs", pairs)):
                asked = _distinct(np.concatenate(arrays or [words[:0]]))
                for b, part in _by_bucket(asked, buckets):
                    rows.setdefault(b, {"batch": batch_id, "bucket": b})[name] = _gaps(asked[part])
            return pa.RecordBatch.from_pylist([own, *rows.values()], schema=_SCORED_ARROW)

        for batch in text_slices(batches, "text", slice_bytes):
            batch_id = (partition << 32) + number
            tokens, owner, history = _tokens([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
            m = batch.num_rows
            unique, back = np.unique(tokens, return_inverse=True)
            at = np.minimum(np.searchsorted(keys_of_head, unique), max(len(keys_of_head) - 1, 0))
            in_head = (keys_of_head[at] == unique) if len(keys_of_head) else np.zeros(len(unique), bool)
            exact = np.where(in_head, counts_of_head[at] if len(keys_of_head) else 0, 0)
            in_head_token = in_head[back]
            base = np.bincount(owner, np.where(in_head_token, np.log10(exact + 1.0)[back], 0.0), m)
            lengths = np.bincount(owner, minlength=m)
            known = np.bincount(owner[in_head_token], minlength=m)
            # words that aren't broadcast are looked up where their counts are
            keys.append(unique[~in_head])
            if sharded:
                scores = np.zeros(m)
                flow.append((unique, back))
                pairs.append(_distinct(pair_hash(history, tokens)))
            else:
                scores = np.bincount(owner, _log_probabilities(tokens, history, lambda keys: filter_.levels(keys, _bucket_of(keys, buckets)), n, v, (keys_of_head, counts_of_head)), m)
                flow.append((unique[~in_head], (np.cumsum(~in_head) - 1)[back[~in_head_token]]))
                texts_of.append(owner[~in_head_token] + len(about))
            about += [dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "base", "score"), x)) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), lengths.tolist(), known.tolist(), (base - lengths * base_log).tolist(), scores.tolist())]
            n_held += len(tokens)
            if n_held >= ask_at:
                yield ask()
                number, n_held = number + 1, 0
                for held in (about, flow, texts_of, keys, pairs):
                    held.clear()
        if about:
            yield ask()

    scored = rows.mapInArrow(giving_back(score), _SCORED)
    if not sharded:  # small then; else more than the texts, and read once
        scored = written(scored, "scored")
    empty = F.lit(None).cast("binary")
    dealt = F.coalesce("bucket", F.pmod(F.xxhash64("batch"), F.lit(buckets)).cast("int"))  # a group's own row passes through any bucket
    asked = scored.select(dealt.alias("to"), F.lit(1).alias("turn"), *scored.columns)
    counts = merged.select(F.col("bucket").alias("to"), F.lit(0).alias("turn"), F.lit(-1).cast("bigint").alias("batch"), "bucket", F.lit(None).cast(_DOCS).alias("docs"), (F.col("part") if sharded else empty).alias("words"), empty.alias("tokens"), "counts", "keys", empty.alias("pairs"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        bucket, held, size = None, nothing, 0
        waiting: list[tuple] = []
        for arrow in batches:
            for to, turn, batch, b, docs, words, tokens, texts, keys, pairs in zip(*(c.to_pylist() for c in arrow.columns)):
                if waiting and (to != bucket or size >= ANSWERED):
                    yield _answers(waiting, *held)
                    waiting, size = [], 0
                if to != bucket:
                    bucket, held = to, nothing
                if turn == 0:
                    held = np.frombuffer(keys, "<u8"), np.frombuffer(texts, "<i8"), None if words is None else FrequencyFilter([np.frombuffer(words, np.uint8)])
                elif docs is not None:
                    yield pa.RecordBatch.from_pylist([{"batch": batch, "bucket": -1, "docs": docs, "words": words, "tokens": tokens, "texts": texts}], schema=_ANSWER_ARROW)
                else:
                    waiting.append((batch, b, keys, pairs))
                    size += (len(keys or b"") + len(pairs or b"")) // 8
        if waiting:
            yield _answers(waiting, *held)

    answers = asked.union(counts).repartitionById(buckets, F.col("to")).sortWithinPartitions("to", "turn", "batch").mapInArrow(giving_back(look_up), _ANSWER)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict | None = None
        answered: list[tuple] = []

        def out() -> pa.RecordBatch:
            docs = {k: [d[k] for d in group["docs"]] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base", "score")}
            known, base, scores, m = np.array(docs["n_known"], np.int64), np.array(docs["base"], float), docs["score"], len(docs["doc_id"])
            words, tokens = _keys(group["words"]), from_planes(group["tokens"], "<u4").astype(np.int64)
            counts, word_levels, levels = (np.concatenate([np.zeros(0, kind), *(from_planes(a[i], kind) for a in answered)]) for i, kind in enumerate(("<i8", "i1", "i1")))
            texts = np.repeat(np.arange(m), docs["n_tokens"]) if sharded else from_planes(group["texts"], "<u4").astype(np.int64)
            if sharded:
                scores = np.bincount(texts, _log_probabilities_of(words, tokens, word_levels, levels, n, v, model.value[1:]), m)
            asked = np.flatnonzero(~np.isin(words, model.value[1], assume_unique=True))
            count = np.zeros(len(words), np.int64)
            count[asked] = counts
            known += np.bincount(texts, count[tokens] > 0, m).astype(np.int64)
            base += np.bincount(texts, np.log10(count + 1.0)[tokens], m)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs["doc_id"], pa.int64()), pa.array(docs["held_out"], pa.bool_()), pa.array(docs["n_tokens"], pa.int64()), pa.array(known), pa.array([n] * m, pa.int64()), pa.array(base), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for arrow in batches:
            for row in arrow.to_pylist():
                if row["docs"] is None:
                    answered.append((row["counts"], row["word_levels"], row["levels"]))
                    continue
                if group is not None:
                    yield out()
                group, answered = row, []
        if group is not None:
            yield out()

    back = answers.repartition(parallelism(spark), "batch").sortWithinPartitions("batch", "bucket")
    return back.mapInArrow(giving_back(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
