"""Operator 11: byte-pair encoding and decoding of whole texts by batched merge rounds.

A text is cut at special tokens, normalised and split into words as the tokenizer's file
says.  The symbols of all words that a slice of texts brings anew lie in one flat array.  A
round finds the rank of every adjacent pair by binary search in the sorted pair keys, takes
the lowest rank of each word and merges that pair wherever the word holds it; words without
a ranked pair leave the array.  Words longer than ``LONG`` symbols would need as many rounds
as they hold ranks, so each of them goes through its ranks in ascending order instead,
touching only the places that change.

Words are looked up by their text, never by a hash.  ``encode_texts`` and ``decode_ids`` are
plain maps: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import text_slices

#: Bytes of text encoded at a time.
TEXT_SLICE = 1 << 20
#: Longer words (in bytes) are merged by ascending rank.
LONG = 1024
#: Words and ids that a worker keeps between slices; beyond, it starts anew.
KEPT_WORDS, KEPT_IDS = 200_000, 2_000_000

NO_RANK = np.int32(np.iinfo(np.int32).max)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Merges:
    """The merges of a vocabulary as sorted pair keys."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.size = max(vocab.values()) + 1
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right = (np.array([vocab[p[i]] for p in parts], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in parts], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_at = keys[order], order.astype(np.int32)
        self.made = made
        # a merge may be done in all places of a word at once if no pair with its result ranks before it
        lowest = np.full(self.size, NO_RANK, np.int32)
        np.minimum.at(lowest, left, np.arange(len(parts), dtype=np.int32))
        np.minimum.at(lowest, right, np.arange(len(parts), dtype=np.int32))
        self.at_once = lowest[made] > np.arange(len(parts))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NO_RANK where they don't merge."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK, np.int32)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_at[at], NO_RANK)

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words that lie end to end; returns their symbols end to end, and each one's number."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        words = np.arange(len(lengths))
        while len(words):
            ends = np.cumsum(lengths)
            first = ends - lengths
            ranks = np.full(len(symbols), NO_RANK, np.int32)
            ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = NO_RANK  # the last symbol of a word has no right neighbour
            lowest = np.minimum.reduceat(ranks, first)
            over = lowest == NO_RANK
            if over.any():
                done.append((words[over], symbols[stretches(first[over], lengths[over])], lengths[over]))
                on = ~over
                keep = stretches(first[on], lengths[on])
                words, lengths, lowest, symbols, ranks = words[on], lengths[on], lowest[on], symbols[keep], ranks[keep]
                if not len(words):
                    break
            owner = np.repeat(np.arange(len(words)), lengths)
            places = np.flatnonzero((ranks == lowest[owner]) & (ranks != NO_RANK))
            places = places[self._apart(places, owner[places], ~self.at_once[ranks[places]])]
            symbols = symbols.copy()
            symbols[places] = self.made[ranks[places]]
            stays = np.ones(len(symbols), bool)
            stays[places + 1] = False
            symbols = symbols[stays]
            lengths = lengths - np.bincount(owner[places], minlength=len(words))
        if not done:
            return symbols[:0], lengths
        numbers = np.concatenate([d[0] for d in done])
        every, counts = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
        order = np.argsort(numbers, kind="stable")
        return every[stretches((np.cumsum(counts) - counts)[order], counts[order])], counts[order]

    @staticmethod
    def _apart(places: np.ndarray, owner: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Which of the ascending places merge now: of touching ones every second, and only the
        first of a word whose merge has to be done one at a time."""
        fresh = np.ones(len(places), bool)
        fresh[1:] = (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])
        at = np.arange(len(places))
        take = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0
        if alone.any():
            leading = np.ones(len(places), bool)
            leading[1:] = owner[1:] != owner[:-1]
            take &= leading | ~alone
        return take

    def by_rank(self, symbols: np.ndarray) -> np.ndarray:
        """Merges one long word: ranks in ascending order, each in all its places."""
        n = len(symbols)
        symbols = np.append(symbols, 0).astype(np.int32)
        after, ahead = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        alive = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            ranks = self.ranks(symbols[places], symbols[after[places]])
            ranked = ranks != NO_RANK
            places, ranks = places[ranked], ranks[ranked]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(places, cuts), ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else []):
                if rank not in waiting:
                    heapq.heappush(heap, rank)
                waiting[rank].append(part)

        note(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places]]
            places = places[after[places] < n]
            places = places[self.ranks(symbols[places], symbols[after[places]]) == rank]
            if not len(places):
                continue
            if self.at_once[rank]:
                touching = np.zeros(len(places), bool)
                touching[1:] = after[places[:-1]] == places[1:]
                at = np.arange(len(places))
                merging = places[(at - np.maximum.accumulate(np.where(touching, 0, at))) % 2 == 0]
            else:
                merging = places[:1]
                if len(places) > 1:
                    heapq.heappush(heap, rank)
                    waiting[rank].append(places[1:])
            gone = after[merging]
            alive[gone] = False
            symbols[merging] = self.made[rank]
            after[merging] = after[gone]
            ahead[after[merging]] = merging
            left = ahead[merging]
            left = left[left >= 0]
            right = merging[after[merging] < n]
            note(np.unique(np.concatenate([left[alive[left]], right])))
        return symbols[:n][alive[:n]]


class BytePairs:
    """Encodes and decodes with a byte-level BPE file whose words carry an end mark.

    It reads the file's normaliser (NFC, white space to one space, lower case by letter) and
    its splitting pattern; another form is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        model, kinds = form["model"], [n["type"] for n in form["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or form["decoder"] or form["post_processor"]:
            raise ValueError(f"{path} is not of the form that this encoder reads")
        split = form["pre_tokenizer"]["pretokenizers"][0]
        self.library = Tokenizer.from_file(path)  # for its splitting rules only, see _words
        self.space = regex.compile(form["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocab = model["vocab"]
        self.merges = Merges(vocab, model["merges"])
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.symbol = np.array([vocab[c] for c in letters], np.int32)
        self.last_symbol = np.array([vocab[c + end] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in form["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.known_letters: set[str] = set()
        self._forget()

    def _forget(self) -> None:
        """The table holds each special token as a word of its own, marked by a leading space."""
        self.places = {f" {t}": i for i, t in enumerate(self.special)}
        self.pool = np.array(list(self.special.values()), np.int32)
        self.starts, self.lengths = np.arange(len(self.special)), np.ones(len(self.special), np.int64)

    def _is_settled(self, text: str) -> bool:
        """Whether Python's tables of letters know every character of the text."""
        new = set(text) - self.known_letters
        unassigned = {c for c in new if unicodedata.category(c) == "Cn"}
        self.known_letters |= new - unassigned
        return not unassigned

    def _words(self, text: str) -> list[str]:
        """The words of one text without special tokens, normalised.

        Letters that are newer than Python's tables are normalised and told apart by the library.
        """
        if text.isascii():
            return self.pattern.findall(text.lower())
        if self._is_settled(text):
            text = self.space.sub(" ", unicodedata.normalize("NFC", text))
            low = text.lower()
            if "Σ" in text or "İ" in text:  # the lower case of these depends on their neighbours
                low = "".join([c.lower() for c in text])
            return self.pattern.findall(low)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _all_words(self, text: str) -> list[str]:
        if not self.special_pattern.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(f" {m.group()}")
            at = m.end()
        return out + self._words(text[at:])

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.symbol[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last_symbol[data[ends - 1]]
        long = lengths > LONG
        if not long.any():
            return self.merges.rounds(symbols, lengths)
        short = stretches((ends - lengths)[~long], lengths[~long])
        merged, counts = self.merges.rounds(symbols[short], lengths[~long])
        apart = iter(np.split(merged, np.cumsum(counts)[:-1]) if len(counts) else [])
        out = [self.merges.by_rank(symbols[e - n : e]) if n > LONG else next(apart) for e, n in zip(ends.tolist(), lengths.tolist())]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the texts' ends (first 0)."""
        if len(self.places) > KEPT_WORDS or len(self.pool) > KEPT_IDS:
            self._forget()
        words: list[str] = []
        counts = [0]
        for text in texts:
            if text:
                words += self._all_words(text)
            counts.append(len(words))
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if new:
            ids, lengths = self._learn(new)
            first = len(self.places)
            self.places.update(zip(new, range(first, first + len(new))))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, ids])
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        sizes = self.lengths[at]
        ids = self.pool[stretches(self.starts[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[counts]
        return ids, ends

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, as a file without a decoder has it; special tokens stay."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """One for each Python worker, which Spark reuses for many tasks."""
    return BytePairs(path)


def encode_texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit integers.

    Special tokens' strings in a text are read as these tokens, none is added.  A null or
    empty text has no ids; null and repeated doc_id are rows like any other; other columns
    are ignored; an empty table gives no rows.  One text is held whole, with some 60 bytes
    for each of its own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(tokenizer_path)
        for batch in text_slices(batches, most=TEXT_SLICE):
            ids, ends = coder.encode(batch.column(1).to_pylist())
            data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to (doc_id, ids); null ids count as none.

    An id outside the vocabulary is an error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(tokenizer_path)
        for batch in text_slices(batches, "ids", most=4 * TEXT_SLICE):
            texts = [coder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    narrow = encoded.select("doc_id", "ids")
    return narrow.mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
