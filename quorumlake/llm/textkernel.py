"""Vectorised hashing of words, lines and byte strings of many texts at once.

A batch of texts is one UTF-8 buffer with offsets. Words are hashed eight bytes at a time by a chain of mixers, so that words
of up to eight bytes are told apart for sure; runs of words by a tree of mixers over their words' hashes. Slices of any
length have polynomial hashes of prefixes modulo the prime 2**61 - 1, with fixed bases: the hash of a slice follows from two
prefixes. Two different slices of n values have equal hashes for n of all 2**61 bases at most, and no pattern of theirs has
them for all bases, as patterns do modulo a power of two.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: The modulus of prefix hashes, and fixed values: bases of the polynomials, two independent pairs.
PRIME = (1 << 61) - 1
BYTE_BASES = (0x1E3779B97F4A7C15 % PRIME, 0x16E8FEB86659FD93 % PRIME)
WORD_BASES = (0x02B2AE3D27D4EB4F % PRIME, 0x0761D6478BD642F5 % PRIME)
#: Seeds of the mixers, one for each independent hash of a word.
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ODD = np.uint64(0x9FB21C651E98DF25)
_EVEN = np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P, _LOW32, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_1, _30, _31, _29, _32, _61 = (np.uint64(x) for x in (1, 30, 31, 29, 32, 61))
#: Bytes of text that one step holds expanded; a longer document makes a step of its own.
STEP_BYTES = 250_000
#: Bytes of a word that are hashed eight at a time; longer words go to hashlib.
SHORT_WORD = 64

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**64."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a and b below it, by halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = ah * bl + al * bh
    return _fold(((ah * bh) << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + al * bl)


class _Powers:
    """Powers of a base modulo PRIME, and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            m = max(n + 1, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = getattr(self, name)
                while len(x) < m:  # powers up to k give those up to 2 * k
                    x = np.concatenate([x, times(x[: m - len(x)], np.uint64(pow(base, len(x), PRIME)))])
                setattr(self, name, x)
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}
#: Powers that a worker keeps; what a longer sequence needs goes with it.
KEPT_POWERS = 1 << 20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT_POWERS:
        return _Powers(base).to(n)
    return _POWERS.setdefault(base, _Powers(base)).to(n)


class Prefixes:
    """Hashes of all slices of a sequence of bytes, or of 64-bit values, which count modulo PRIME."""

    def __init__(self, values: np.ndarray, base: int):
        self.n = len(values)
        up, self.down = powers(base, self.n)
        up = up[: self.n]
        if values.dtype == np.uint8 and self.n <= 1 << 22:  # products of a byte and half a power, so many of them, stay below 2**64
            values = values.astype(np.uint64) + _1
            low, high = np.cumsum(values * (up & _LOW32)), np.cumsum(values * (up >> _32))
        else:
            terms = times(values.astype(np.uint64) + _1 if values.dtype == np.uint8 else _fold(values), up)
            low, high = np.cumsum(terms & _LOW32), np.cumsum(terms >> _32)
        low, high = _fold(low), _fold(high)
        self.sums = np.zeros(self.n + 1, np.uint64)
        self.sums[1:] = _fold(low + ((high << _32) & _P) + (high >> _29))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the slices [start, end): equal content gives equal hashes, wherever it stands."""
        gap = self.sums[end] + (_P - self.sums[start])
        return times(np.where(gap >= _P, gap - _P, gap), self.down[start])


class Rolling:
    """Hashes of all slices of bytes modulo 2**64: cheap, and only for choosing places, as other bytes may have the same."""

    def __init__(self, data: np.ndarray):
        n, base = len(data), SEEDS[0] | 1
        up, self.down = (np.full(n + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = self.down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _1) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, width: int) -> np.ndarray:
        """Of each run of width bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as an integer, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each byte string data[start:end]; which: of the independent ones."""
    size = end - start
    seed = np.uint64(SEEDS[which])
    out = mix(size.astype(np.uint64) * _ODD + seed)
    view, at = eights(data), np.flatnonzero(size <= SHORT_WORD)
    done = 0
    while len(at):
        left = size[at] - done
        bits = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(bits == 64, ~np.uint64(0), (_1 << (bits % np.uint64(64))) - _1)
        out[at] = mix((out[at] ^ (view[start[at] + done] & mask)) * _ODD + seed)
        at, done = at[left > 8], done + 8
    long = np.flatnonzero(size > SHORT_WORD)
    if len(long):
        raw, key = data.tobytes(), int(seed).to_bytes(8, "little")
        for i, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist(), strict=True):
            out[i] = int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest(), "little")
    return out


@dataclass
class Texts:
    """UTF-8 bytes of some texts on end; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray
    rows: slice
    _words: tuple | None = field(default=None, repr=False)

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word: runs of bytes other than ASCII white space, never over a text's end."""
        if self._words is None:
            w = ~SPACE[self.data]
            first, last = w.copy(), w.copy()
            first[1:] &= ~w[:-1]
            last[:-1] &= ~w[1:]
            inner = self.offsets[:-1]
            inner = inner[inner < len(w)]
            first[inner] = w[inner]
            before = self.offsets[1:] - 1
            before = before[before >= 0]
            last[before] = w[before]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            self._words = start, end, self.doc_of(start)
        return self._words

    def word_hashes(self, which: int = 0, table: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word; table: of 256 bytes, to see other bytes in place of those in the text."""
        start, end, _ = self.words()
        return slice_hashes(self.data if table is None else table[self.data], start, end, which)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, the order of both counting."""
    return mix(mix(left * _ODD + _EVEN) ^ (right * _EVEN + _ODD))


def windows(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of width words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(docs[:n] == docs[width - 1 :])
    # runs of powers of two, each joined from two halves; those of the width's binary digits one after the other make the window
    run, size, out, done = hashes, 1, None, 0
    while True:
        if width & size:
            part = run[done : done + n]
            out, done = part if out is None else _joined(out, part), done + size
        if done == width:
            return start, mix(out)[start]
        run, size = _joined(run[:-size], run[size:]), 2 * size


def in_doc(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Hashes made to differ between texts, to find repeats inside each."""
    return mix(hashes + mix(docs.astype(np.uint64) + _ODD))


def covered(n: int, start: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window [start, start + width)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the ranges first..last (last included), one range after the other."""
    n = last - first + 1
    before = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    return np.arange(int(n.sum())) + np.repeat(first - before, n)


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column (null: empty) in steps of about limit bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], slice(i, j))
        i = j


def signed(x: np.ndarray) -> pa.Array:
    """Hashes as the signed longs that Spark has."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
