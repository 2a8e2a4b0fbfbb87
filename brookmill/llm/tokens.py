"""Tokenizing whole texts inside Arrow tasks with the public tokenizers library.

A text is cut only where the tokenizer's own splitting rule always cuts it.  The cuts and a
64-bit hash of every piece are found for a whole slice of texts at once; the pieces that the
worker has not met are encoded by the library in one batch, and a table of pieces, bounded in
bytes, is kept between slices.  Most words of a corpus repeat, so the library sees each of
them once instead of once per occurrence.  Texts that hold a string of a special token, or
white space outside ASCII, are not cut at all.

Pieces of equal length up to eight bytes never share a hash; of longer ones two among the n
of a table do with a probability of some n² / 2**65, 10**-7 for a full table, as far as the hash
is like a random function: it mixes the bytes by steps that no pattern of letters undoes.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .hashing import piece_hashes

#: Bytes that the table of one worker may take.
TABLE_BYTES = 32 << 20
#: Bytes of text encoded at a time.
TEXT_SLICE = 1 << 20
#: Longer pieces are encoded but not kept.
MAX_PIECE_BYTES = 64

_ODD_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_SPACE = np.zeros(256, bool)
_WORD_SPACE[[9, 10, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER
_MARK[48:58] = False


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and each one's first place; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


class _Table:
    """Sorted piece hashes with each one's ids in a common pool, and when it was last used."""

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.pool = np.zeros(0, np.uint64), np.zeros(0, self.dtype)
        self.starts, self.lengths, self.used = (np.zeros(0, np.int32) for _ in range(3))

    def bytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.pool, self.starts, self.lengths, self.used))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ascending keys are, and which of them are held."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray, now: int) -> None:
        """Takes up ascending keys that aren't held; the least recently used half goes if there is no room."""
        if self.bytes() + keys.nbytes + ids.nbytes + 12 * len(keys) > TABLE_BYTES:
            self._keep(self.used > np.median(self.used))
        at = np.searchsorted(self.keys, keys)
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts.astype(np.int32))
        self.lengths = np.insert(self.lengths, at, lengths.astype(np.int32))
        self.used = np.insert(self.used, at, np.int32(now))
        self.pool = np.concatenate([self.pool, ids])

    def _keep(self, chosen: np.ndarray) -> None:
        lengths = self.lengths[chosen]
        self.pool = self.pool[_stretches(self.starts[chosen], lengths)]
        self.keys, self.used, self.lengths = self.keys[chosen], self.used[chosen], lengths
        self.starts = (np.cumsum(lengths) - lengths).astype(np.int32)


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class TextEncoder:
    """Encodes slices of texts to ids.

    ``by_space``: the rule keeps white space (byte-level rule), and a piece is white space with
    the visible run after it.  Otherwise white space only separates, and pieces are the visible
    runs.  Under both, a mark after a letter begins a piece.
    """

    def __init__(self, path: str, by_space: bool):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.by_space = by_space
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        #: ids that begin a word of letters after a space, or end one
        self.border = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.startswith("Ġ") if by_space else token.endswith("</w>")
        self.table, self.slices = _Table(self.dtype), 0

    def _uncut(self, texts: pa.Array, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Numbers of the texts that the library must see whole."""
        raw = data.tobytes()
        suspect = np.zeros(len(texts), bool)
        if b"<" in raw:
            hits = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(data == 60)])[borders]) > 0)
            suspect[hits] = True
        if self.by_space and not raw.isascii():
            suspect |= np.diff(np.concatenate([[0], np.cumsum(data >= 128)])[borders]) > 0
        out = []
        for i in np.flatnonzero(suspect).tolist():
            text = raw[borders[i] : borders[i + 1]].decode("utf-8", "surrogatepass")
            if self.special.search(text) or (self.by_space and _ODD_SPACE.search(text)):
                out.append(i)
        return np.array(out, np.int64)

    def _pieces(self, texts: pa.Array, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of all pieces in order; none is empty."""
        n = len(data)
        space = (_SPACE if self.by_space else _WORD_SPACE)[data]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (_LETTER[data[:-1]] & _MARK[data[1:]]) | (~space[:-1] & space[1:])
        if self.by_space:  # a single line end between visible characters stands alone
            cut[2:n] |= (data[1:-1] == 10) & ~space[:-2] & ~space[2:]
        else:
            cut[1:n] |= space[:-1] & ~space[1:]
        uncut = self._uncut(texts, data, borders)
        for i in uncut.tolist():
            cut[borders[i] : borders[i + 1]] = False
        cut[borders[:-1][np.diff(borders) > 0]] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        if not self.by_space and len(starts):
            whole = np.zeros(n + 1, bool)
            whole[borders[uncut]] = True
            use = ~space[starts] | whole[starts]
            starts, ends = starts[use], ends[use]
        return starts, ends

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        prefix = " " if self.by_space else ""
        # words of Latin letters go through the library in long joined texts: the first or
        # last id of each shows where it is
        plain = [i for i, p in enumerate(pieces) if len(p) <= MAX_PIECE_BYTES and p[len(prefix) :].isalpha() and p.startswith(prefix) and max(p) <= "\xff"]
        ids, lengths, owner = array("I"), [], []
        rest = np.setdiff1d(np.arange(len(pieces)), plain, assume_unique=True).tolist()
        for begin in range(0, len(plain), 2000):
            part = plain[begin : begin + 2000]
            joined = ("" if self.by_space else " ").join([pieces[i] for i in part])
            got = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            at = np.flatnonzero(self.border[got])
            if len(at) == len(part):
                lengths += np.diff(np.append(at, len(got)) if self.by_space else np.concatenate([[-1], at])).tolist()
                owner += part
                ids.extend(got)
            else:
                rest += part
        for begin in range(0, len(rest), 20_000):
            part = rest[begin : begin + 20_000]
            for e in self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False):
                got = e.ids
                ids.extend(got)
                lengths.append(len(got))
            owner += part
        order = np.argsort(np.array(owner, np.int64))
        lengths = np.array(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        return np.array(ids, self.dtype)[_stretches(starts[order], lengths[order])], lengths[order]

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each followed by ``end_id`` if there is one, and the
        texts' ends (first 0)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        data, borders = _bytes_of(texts)
        starts, ends = self._pieces(texts, data, borders)
        keys = piece_hashes(data, starts, ends)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        unique, one = ordered[first], order[first]
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(first) - 1
        at, known = self.table.find(unique)
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        new_starts, new_ends = starts[one[new]], ends[one[new]]
        new_ids, new_lengths = self._learn([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(new_starts.tolist(), new_ends.tolist())])
        place, length = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        if known.any():
            place[known], length[known] = self.table.starts[at[known]], self.table.lengths[at[known]]
            self.slices += 1
            self.table.used[at[known]] = self.slices
        first_new = np.cumsum(new_lengths) - new_lengths
        place[new], length[new] = len(self.table.pool) + first_new, new_lengths
        count = length[back]
        ids = np.concatenate([self.table.pool, new_ids])[_stretches(place[back], count)]
        text_ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, borders)]
        keep = np.flatnonzero(new_ends - new_starts <= MAX_PIECE_BYTES)
        if len(keep):
            self.table.add(unique[new[keep]], new_ids[_stretches(first_new[keep], new_lengths[keep])], new_lengths[keep], self.slices)
        if end_id is None:
            return ids, text_ends
        marks = text_ends[1:] + np.arange(len(texts))
        out = np.full(len(ids) + len(texts), end_id, ids.dtype)
        own = np.ones(len(out), bool)
        own[marks] = False
        out[own] = ids
        return out, np.concatenate([[0], marks + 1])


@lru_cache(maxsize=2)
def encoder(path: str, by_space: bool) -> TextEncoder:
    """One encoder for each Python worker, which Spark reuses for many tasks."""
    return TextEncoder(path, by_space)
