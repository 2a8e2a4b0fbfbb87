"""Vectorised hashing of words and of stretches of bytes, shared by the text operators.

* ``piece_hashes`` is for words: eight bytes at a time are mixed into a state by steps that no
  algebra of the letters undoes; long pieces go through BLAKE2b.
* ``prefix_sums`` and ``stretch_hashes`` are for strings at many places of one buffer: the hash of
  b0 b1 ... is the sum of T[b_i] * B**i modulo the prime 2**61 - 1, with a table T of random
  numbers.  Two given strings of equal length collide for one in some 2**61 tables.  (Modulo a
  power of two that would be false: Thue-Morse words collide there for every base and table.)
* ``rolling_hashes`` of short windows, modulo 2**64, only choose places.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Slice size for operators that hold several words per byte.
HASH_SLICE = 1 << 20
#: Longer pieces are hashed one by one.
LONG_PIECE = 256

_P = np.uint64((1 << 61) - 1)
_LOW31, _LOW30, _S31, _S30, _S61 = (np.uint64(x) for x in ((1 << 31) - 1, (1 << 30) - 1, 31, 30, 61))
_BASE = 0x1E3779B97F4A7C15 % ((1 << 61) - 1)
_TABLE = np.random.default_rng(7).integers(1, (1 << 61) - 1, 256, np.uint64)
_ROLLING_TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_ROLLING_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it, by halves of 31 bits."""
    high_a, low_a, high_b, low_b = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = low_a * high_b + high_a * low_b
    return _reduced(((high_a * high_b) << np.uint64(1)) + (middle >> _S30) + ((middle & _LOW30) << _S31) + low_a * low_b)


def _growing(name: str, n: int, first: int, product) -> np.ndarray:
    """first**0 ... first**(n-1) by doubling; kept unless one very long text needs them."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, HASH_SLICE + 4096)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            step = np.full(len(have), product(have[-1:], np.uint64(first))[0], np.uint64)
            have = np.concatenate([have, product(have, step)])
        have = have[:size]
        if size <= 2 * HASH_SLICE:
            _powers[name] = have
    return have[:n]


def _field_powers(n: int, inverse: bool = False) -> np.ndarray:
    return _growing("inverse" if inverse else "field", n, pow(_BASE, -1, int(_P)) if inverse else _BASE, times)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """h with h[0] = 0, so that bytes [a, b) hash to (h[b] - h[a]) * B**-a modulo the prime."""
    terms = times(_TABLE[data], _field_powers(len(data)))
    high, low = np.cumsum(terms >> _S31), np.cumsum(terms & _LOW31)  # both far below 2**61
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = _reduced(times(_reduced(high), np.full(1, 1 << 31, np.uint64)) + _reduced(low))
    return out


def stretch_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    difference = h[ends] + (_P - h[starts])
    return times(np.where(difference >= _P, difference - _P, difference), _field_powers(len(h), True)[starts])


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` bytes modulo 2**64, for choosing places."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)

    def product(a, b):
        return a * b

    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_ROLLING_TABLE[data] * _growing("rolling", len(data), _ROLLING_BASE, product), out=h[1:])
    return (h[width:] - h[:-width]) * _growing("unrolling", n, pow(_ROLLING_BASE, -1, 1 << 64), product)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all its bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces [start, end) of a buffer; equal bytes give equal hashes."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    active, done = np.flatnonzero((lengths > 0) & (lengths <= LONG_PIECE)), 0
    while len(active):
        lanes = eight[starts[active] + done]
        left = np.minimum(lengths[active] - done, 8).astype(np.uint64)
        lanes = lanes & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - (left << np.uint64(3))))
        out[active] = mix((out[active] ^ lanes) * np.uint64(0x8EBC6AF09C88C6E3) + (out[active] >> np.uint64(29)))
        done += 8
        active = active[lengths[active] > done]
    long = np.flatnonzero(lengths > LONG_PIECE)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the texts in order.

    A-Z is lower-cased; words are runs without ASCII white space.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACE[data]
    inside = ~space
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(space & ~before)
    borders = np.cumsum([len(t) + 1 for t in texts])
    return piece_hashes(data, starts, ends), np.searchsorted(borders, starts, "right")
