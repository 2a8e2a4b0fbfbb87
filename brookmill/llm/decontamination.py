"""Operator 6: benchmark decontamination by latent semantic retrieval.

Texts are cut into chunks of ``CHUNK`` words, rows of a TF-IDF matrix over hashed words.  A
randomised SVD of that matrix is taken in one distributed pass: every task multiplies its
rows by a Gaussian matrix and back, the products are added up, and a Nystroem step on the
small result gives right singular vectors and singular values.  In the latent space, scaled
by the singular values, passages of each item's length are compared with the item by two cosines:
in all RANK dimensions, where words in common decide, and in the leading TOPICS ones, where words
of like company lie together, so that a passage in other words is found as well.  Words that all
texts share carry no weight.  A candidate is verified where it was found: first its word signature must not lack too many of the item's bits, which no leak
does; then the longest common subsequence of words with the item is taken.  A text leaks an item if a passage

* holds ALONE of the item's words in order, or WITH_ANSWER of them and all words of its answer, its last
  words.  No such leak depends on the cosine: a passage that holds so many of an item's words holds one of its
  rarest, whatever stands around it, so passages with such a word are candidates too; or
* is a paraphrase: one of its cosines with the item is LEAST_COSINE or TOPIC_COSINE or more, it holds PARAPHRASE
  of the item's words in order and all words of its answer.  These come from the latent search alone, for items of PARAPHRASED
  words and more.

An item of a few words only is found where all its words follow one another.

Document frequencies and the SVD cover all texts.  Items are broadcast in blocks of bounded
size, each compared with all texts in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, parallelism, text_slices
from .hashing import mix, piece_hashes

#: Words of a chunk, hashed words, latent dimensions and extra ones for the sketch.
CHUNK, DIM_BITS, RANK, EXTRA = 16, 13, 160, 8
DIMS = 1 << DIM_BITS
#: Leading dimensions that stand for topics; a paraphrase has one of these cosines with its item at the least.
TOPICS, LEAST_COSINE, TOPIC_COSINE = 64, 0.2, 0.55
#: Share of the item's words that it holds in order, with the answer; words of the shortest items looked for in other words.
PARAPHRASE, PARAPHRASED = 0.45, 24
#: Share of an item's words in common order that proves a leak, alone or with the answer.
ALONE, WITH_ANSWER, ANSWER_WORDS = 0.8, 0.6, 5
#: Items of fewer words are looked for as they are; items broadcast at a time, and compared at a time.
LEAST_WORDS, ITEM_BLOCK, ITEMS_AT_ONCE = 5, 20_000, 1000
_ROWS = 64  # rows of the sketch that travel together
#: 64-bit words of a signature, which has a bit for each word.
_SIGNATURE = 8
#: Bytes of text handled at a time; what they need fits a processor's cache.
_SLICE = 1 << 19

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of letters and digits, A-Z lower-cased."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]).lower(), np.uint8)
    inside = _WORD[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    return piece_hashes(data, starts, ends), np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts - 1, "right")


class Chunks:
    """The words of a slice as rows of CHUNK hashed words, filled up with the place DIMS."""

    def __init__(self, texts: list[str | None]):
        self.hashes, owner = words(texts)
        n = len(self.hashes)
        self.text_borders = np.searchsorted(owner, np.arange(len(texts) + 1))
        place = np.arange(n) - self.text_borders[owner]
        new = place % CHUNK == 0
        self.starts = np.flatnonzero(new)
        self.chunk_of = np.cumsum(new) - 1
        self.owner = owner[self.starts]
        self.places = (self.hashes >> np.uint64(64 - DIM_BITS)).astype(np.uint16)
        self.rows = np.full((len(self.starts), CHUNK), DIMS, np.uint16)
        self.rows[self.chunk_of, place % CHUNK] = self.places

    def signatures(self) -> np.ndarray:
        """Bits of the words of each chunk."""
        out = np.zeros((len(self.rows), _SIGNATURE), np.uint64)
        word, bit = _signature_bits(self.hashes)
        np.bitwise_or.at(out, (self.chunk_of, word), bit)
        return out

    def times(self, table: np.ndarray) -> np.ndarray:
        """The chunks' rows of counts times ``table``, which has a last row of zeros."""
        return _sums(self.rows, table)

    def transposed_times(self, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, rows): the transposed counts times one row a chunk, for the places that occur.

        A place's chunks are taken eight at a time, and then these sums are added up.
        """
        if not len(self.rows):
            return np.zeros(0, np.int64), np.zeros((0, product.shape[1]), np.float32)
        order = np.argsort(self.places, kind="stable")
        places = self.places[order]
        change = np.concatenate([[True], places[1:] != places[:-1]])
        at = np.arange(len(places)) - np.flatnonzero(change)[np.cumsum(change) - 1]
        new = at % 8 == 0
        members = np.full((int(new.sum()), 8), len(product), np.int64)
        members[np.cumsum(new) - 1, at % 8] = self.chunk_of[order]
        groups, of_group = _sums(members, _with_zero(product)), places[new]
        first = np.flatnonzero(np.concatenate([[True], of_group[1:] != of_group[:-1]]))
        return of_group[first].astype(np.int64), np.add.reduceat(groups, first, axis=0)


def _sums(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each row of numbers of rows of ``table``, the sum of these."""
    out = np.zeros((len(rows), table.shape[1]), np.float32)
    taken = np.empty((min(len(rows), 1024), table.shape[1]), np.float32)
    for start in range(0, len(rows), 1024):
        part = out[start : start + 1024]
        for column in rows[start : start + 1024].T:
            part += np.take(table, column, axis=0, out=taken[: len(part)], mode="clip")
    return out


def _signature_bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (hashes & np.uint64(64 * _SIGNATURE - 1)).astype(np.int64)
    return low >> 6, np.uint64(1) << (low & 63).astype(np.uint64)


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.vstack([table.astype(np.float32), np.zeros((1, table.shape[1]), np.float32)])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log(chunks / chunks with the place), from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in text_slices(batches, "text", _SLICE):
            chunks = Chunks(batch.column(0).to_pylist())
            pairs = np.sort(chunks.chunk_of.astype(np.uint64) << np.uint64(DIM_BITS) | chunks.places.astype(np.uint64))
            if len(pairs):
                once = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
                total[:DIMS] += np.bincount((once & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
                total[DIMS] += len(chunks.rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], names=["place", "n"])

    total = np.zeros(DIMS + 1)
    for place, n in docs.select("text").mapInArrow(giving_back(run), "place long, n long").groupBy("place").agg(F.sum("n")).collect():  # DIMS + 1 rows
        total[place] = n
    return np.log((1 + total[DIMS]) / (1 + total[:DIMS]))


def randomised_svd(docs: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (DIMS x rank) and singular values of the TF-IDF matrix of all chunks.

    A task sends one sketch of DIMS x (rank + EXTRA) numbers, so the texts are read by two tasks a
    core (by Spark's default parallelism; set it where executors come and go): what is shuffled
    follows the cluster and not the texts.
    """
    width = rank + EXTRA
    gauss = np.random.default_rng(2024).standard_normal((DIMS, width))
    forward, weights = _with_zero(idf[:, None] * gauss), idf.astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS, width), np.float64)
        for batch in text_slices(batches, "text", _SLICE):
            chunks = Chunks(batch.column(0).to_pylist())
            places, sums = chunks.transposed_times(chunks.times(forward))
            total[places] += sums
        total *= weights[:, None]
        blocks = DIMS // _ROWS
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks), pa.int32()), pa.array([total[b * _ROWS : (b + 1) * _ROWS].astype(np.float32).tobytes() for b in range(blocks)], pa.binary())], names=["block", "data"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[block] = sums.get(block, 0) + np.frombuffer(data, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "data"])

    sketched = docs.select("text").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(giving_back(sketch), "block int, data binary")
    added = sketched.repartition(min(parallelism(docs.sparkSession), DIMS // _ROWS), "block").mapInArrow(giving_back(add_up), "block int, data binary")
    z = np.zeros((DIMS, width))
    for block, data in added.collect():  # DIMS x width numbers in all
        z[block * _ROWS : (block + 1) * _ROWS] = np.frombuffer(data).reshape(_ROWS, width)
    # Nystroem: A'A is about Z (G'Z)^-1 Z'
    shift = 1e-9 * max(np.linalg.norm(z), 1.0)
    core = gauss.T @ (z + shift * gauss)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-7  # sums of single precision
    half = (z + shift * gauss) @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :rank], s[:rank]


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in text:
        matched = row & masks.get(word, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(item) - row.bit_count()


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.bool_()), ("topic_cosine", pa.float64())])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, answer, topic_cosine: one row for each text and benchmark item it holds.

    ``common`` is the greatest share of the item's words that a passage of the text holds in
    order, ``answer`` whether the best passage holds all of the item's last words.  Items and
    texts that are null or have no word match nothing; an item of fewer than LEAST_WORDS words
    matches where they follow one another.
    Rows that repeat are compared each on their own; other columns are ignored; if either
    table is empty there are no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    idf = inverse_frequencies(narrow)
    vectors, values = randomised_svd(narrow, idf)
    latent = _with_zero(idf[:, None] * vectors / np.maximum(values, values.max(initial=0) * 1e-4 + 1e-12))
    found, block = None, []

    def search(block: list[tuple[int, str]]) -> DataFrame:
        return narrow.mapInArrow(giving_back(_searcher(block, latent, idf, docs.sparkSession)), "doc_id long, item_id long, cosine double, common double, answer boolean, topic_cosine double")

    rows = items.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator()
    for row in rows:
        block.append((row["item_id"], row["text"]))
        if len(block) == ITEM_BLOCK:
            found = search(block) if found is None else found.union(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.union(search(block))
    return found


class Seeds:
    """The rarest words of each item, so many that every leak of the item holds one.

    A leak holds at least a share WITH_ANSWER of the item's words, so it lacks fewer places
    than are taken here.
    """

    def __init__(self, item_words: list[list[int]], idf: np.ndarray):
        pairs = set()
        for i, item in enumerate(item_words):
            n = len(item)
            if n:
                least = n if n < LEAST_WORDS else next(k for k in range(n + 1) if k / n >= min(ALONE, WITH_ANSWER))
                rarest = sorted(item, key=lambda w: (-idf[w >> 64 - DIM_BITS], w))[: n - least + 1]
                pairs.update((w, i) for w in rarest)
        held = sorted(pairs)
        of_pair = np.array([w for w, _ in held], np.uint64)
        self.words, first = np.unique(of_pair, return_index=True)
        self.borders = np.append(first, len(held))
        self.items = np.array([i for _, i in held], np.int64)
        self.any = np.zeros(1 << 16, bool)
        self.any[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray, chunk_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, item) for each place of a text that holds a rare word of an item."""
        at = np.flatnonzero(self.any[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(at) or not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
        same = self.words[word] == hashes[at]
        at, word = at[same], word[same]
        n = self.borders[word + 1] - self.borders[word]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(chunk_of[at], n), self.items[np.repeat(self.borders[word], n) + step]


def _searcher(block: list[tuple[int, str]], latent: np.ndarray, idf: np.ndarray, spark):
    hashes, owner = words([t for _, t in block])
    borders = np.searchsorted(owner, np.arange(len(block) + 1))
    x = np.zeros((len(block), latent.shape[1]), np.float32)
    np.add.at(x, owner, latent[(hashes >> np.uint64(64 - DIM_BITS)).astype(np.int64)])
    topics = _unit(x[:, :TOPICS])
    x = _unit(x)
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(np.diff(borders).tolist()):
        if n:
            by_size.setdefault(-(-n // CHUNK) + 1, []).append(i)
    item_words = [hashes[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])]
    signatures = np.zeros((len(block), _SIGNATURE), np.uint64)
    word, bit = _signature_bits(hashes)
    np.bitwise_or.at(signatures, (owner, word), bit)
    # a common subsequence of that share leaves out at most so many words, and so bits
    sizes = np.diff(borders)
    may_lack = np.where(sizes < LEAST_WORDS, 0, np.floor((1 - min(ALONE, WITH_ANSWER)) * sizes + 1e-9))
    reworded_lack = np.where(sizes < PARAPHRASED, -1, np.floor((1 - PARAPHRASE) * sizes + 1e-9))
    ends = np.zeros_like(signatures)
    last = np.arange(len(hashes)) >= borders[owner + 1] - ANSWER_WORDS
    np.bitwise_or.at(ends, (owner[last], word[last]), bit[last])
    shared = spark.sparkContext.broadcast(([i for i, _ in block], item_words, x, topics, by_size, latent, signatures, ends, may_lack, reworded_lack, Seeds(item_words, idf)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_words, x, topics, by_size, table, signatures, ends, may_lack, reworded_lack, seeds = shared.value
        for batch in text_slices(batches, "text", _SLICE):
            chunks = Chunks(batch.column(1).to_pylist())
            rows = chunks.times(table)
            n = len(rows)
            best: dict[tuple[int, int], tuple] = {}
            passage, size = rows.copy(), 1
            chunk_bits = chunks.signatures()
            bits = chunk_bits.copy()
            first_chunk = np.searchsorted(chunks.owner, chunks.owner)
            seed_chunk, seed_item = seeds.found(chunks.hashes, chunks.chunk_of)
            place_of = np.zeros(len(item_words), np.int64)
            for wanted in sorted(by_size):
                while size < wanted:  # a passage ends with its text
                    if n > size:
                        inside = chunks.owner[size:] == chunks.owner[:-size]
                        passage[:-size][inside] += rows[size:][inside]
                        bits[:-size][inside] |= chunk_bits[size:][inside]
                    size += 1
                whole, leading = _unit(passage), _unit(passage[:, :TOPICS])
                for begin in range(0, len(by_size[wanted]), ITEMS_AT_ONCE):
                    own = by_size[wanted][begin : begin + ITEMS_AT_ONCE]
                    cosines, topic_cosines = whole @ x[own].T, leading @ topics[own].T
                    place_of[:] = -1
                    place_of[own] = np.arange(len(own))
                    mine = place_of[seed_item] >= 0
                    held = np.unique(seed_chunk[mine] * len(own) + place_of[seed_item[mine]])
                    back = np.arange(wanted)[:, None]  # passages that reach the chunk
                    starts, which = held // len(own) - back, np.broadcast_to(held % len(own), (wanted, len(held)))
                    inside = starts >= first_chunk[held // len(own)]
                    alike = (cosines >= LEAST_COSINE) | (topic_cosines >= TOPIC_COSINE)
                    close = np.flatnonzero(alike.ravel())
                    near, which = np.divmod(np.union1d(starts[inside] * len(own) + which[inside], close), len(own))
                    items = np.array(own)[which]
                    lacking = np.bitwise_count(signatures[items] & ~bits[near]).sum(axis=1)
                    use = lacking <= may_lack[items]
                    other = np.flatnonzero(~use & (lacking <= reworded_lack[items]) & alike[near, which])
                    use[other] = ~(ends[items[other]] & ~bits[near[other]]).any(axis=1)
                    for at, k in zip(near[use].tolist(), which[use].tolist()):
                        text, item = int(chunks.owner[at]), own[k]
                        a = chunks.starts[at]
                        passage_words = chunks.hashes[a : min(a + wanted * CHUNK, chunks.text_borders[text + 1])].tolist()
                        needed = item_words[item]
                        if len(needed) < LEAST_WORDS:
                            share = float(any(passage_words[i : i + len(needed)] == needed for i in range(len(passage_words))))
                        else:
                            share = common_subsequence(needed, passage_words) / len(needed)
                        answer = set(needed[-ANSWER_WORDS:]) <= set(passage_words)
                        reworded = share >= PARAPHRASE and len(needed) >= PARAPHRASED and alike[at, k]
                        if share >= ALONE or (answer and (share >= WITH_ANSWER or reworded)):
                            new = (share, answer, float(cosines[at, k]), float(topic_cosines[at, k]))
                            best[text, item] = max(best.get((text, item), new), new)
            doc_ids = batch.column(0).to_pylist()
            out = [{"doc_id": doc_ids[t], "item_id": ids[i], "cosine": c, "common": s, "answer": a, "topic_cosine": tc} for (t, i), (s, a, c, tc) in sorted(best.items())]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return run
