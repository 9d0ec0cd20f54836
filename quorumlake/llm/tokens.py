"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once by a worker.

Both families of tokenizer files split a text into pre-tokens before they merge anything, and no pre-token holds a letter
or digit followed by an ASCII character of another class, nor anything followed by white space. A text may be cut at such
places, and its ids are those of the parts on end. "words" tokenizers drop white space and fold case, so that parts lie
between white space and are looked up in ASCII lower case; "bytes" tokenizers keep it, and a part has the white space
before it, but that a single line end is a part of its own. Next to characters that may be white space beyond ASCII no cut
is made.

Parts are found, hashed and looked up with numpy; only parts that a worker has not met go to the tokenizer. A known part
is found by 64 bits of hash with its length and first eight bytes, and all bytes of longer parts are compared with those
kept. Parts of more than LONGEST_KEPT bytes go to the tokenizer each time.

The library takes the strings of added tokens out before anything else, and what stands between them is a text of its own;
so each is a part. No other part holds one: what case folding makes look like one is cut after its letters.
"""

import re
from itertools import chain

import numpy as np

from .textkernel import LOWER, SPACE, Texts, eights, slice_hashes, spans

#: Parts that a worker remembers, in a table of twice as many places of 24 bytes; beyond that it starts anew. Longer parts are not kept.
CACHE_PARTS = 2_000_000
LONGEST_KEPT = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[range(48, 58)] = True
_ASCII = np.arange(256) < 128
#: First bytes of characters among which there is white space.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def part_ends(t: Texts, kind: str, whole: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each part of some texts; whole: places that are parts of their own."""
    d, n = t.data, len(t.data)
    cut = np.zeros(n + 1, bool)  # a cut before a place
    cut[t.offsets] = True
    if n > 1:
        a, b = d[:-1], d[1:]
        cut[1:-1] |= (_LETTER[a] & _ASCII[b] & ~_LETTER[b]) | (_DIGIT[a] & _ASCII[b] & ~_DIGIT[b])
        if kind == "words":
            cut[1:-1] |= SPACE[a] != SPACE[b]
        else:
            # before white space, if what stands there is surely none; of characters beyond ASCII, those of two bytes from C3 on
            sure = _ASCII[a] & ~SPACE[a]
            sure[1:] |= d[:-2] == 0xC3
            cut[1:-1] |= sure & SPACE[b]
            # after a single line end, if what follows is surely no white space
            line = (a == 10) & ~SPACE[b] & ~_DOUBT[b]
            line[1:] &= (_ASCII[d[:-2]] & ~SPACE[d[:-2]]) | cut[1:-2]
            cut[1:-1] |= line
    for first, last in whole or []:
        cut[first : last + 1] = False
        cut[[first, last]] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    if kind == "words" and len(start):
        full = ~SPACE[d[start]]
        start, end = start[full], end[full]
    return start, end


class PartTable:
    """Places of known parts, found by hash: open addressing in numpy arrays."""

    def __init__(self, parts: int):
        self.bits = max(4, (2 * parts - 1).bit_length())
        n = 1 << self.bits
        self.keys, self.checks, self.values = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those not in the table."""
        out = np.full(len(keys), -1, np.int64)
        slot, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            s = slot[open_]
            value = self.values[s]
            hit = (self.keys[s] == keys[open_]) & (self.checks[s] == checks[open_]) & (value >= 0)
            out[open_[hit]] = value[hit]
            open_ = open_[(value >= 0) & ~hit]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct entries that are not there."""
        slot, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            s = slot[open_]
            free = self.values[s] < 0
            mine = open_[free]
            self.values[s[free]] = values[mine]
            won = self.values[s] == values[open_]
            w = open_[won]
            self.keys[slot[w]], self.checks[slot[w]] = keys[w], checks[w]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)


class PieceEncoder:
    """encode(texts) -> ids of all texts on end (uint32) and the number of ids of each text.

    added: a string of one of the file's added tokens in a text is that token, as in the library's plain call; else it is text.
    """

    def __init__(self, path: str, kind: str, added: bool = False):
        from tokenizers import Tokenizer

        assert kind in ("words", "bytes"), kind
        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path)
        self.added: list[bytes] = []
        if added:
            tokens = self.tokenizer.get_added_tokens_decoder().values()
            assert not any(x.single_word or x.lstrip or x.rstrip or x.normalized for x in tokens), path
            self.added = sorted((x.content.encode() for x in tokens), key=len, reverse=True)
        else:
            self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.table = PartTable(CACHE_PARTS)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.bytes, self.byte_ends = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int64)
        self.used = self.parts = 0

    def _learn(self, new: list[bytes]) -> None:
        """Keeps the ids and the bytes of parts, numbered on from self.parts."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, first = int(sizes.sum()), self.parts
        self.parts += len(new)
        self.flat, self.bytes = _room(self.flat, self.used + total), _room(self.bytes, int(self.byte_ends[first]) + sum(map(len, new)))
        self.ends, self.byte_ends = _room(self.ends, self.parts + 1), _room(self.byte_ends, self.parts + 1)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.ends[first + 1 : self.parts + 1] = self.used + np.cumsum(sizes)
        self.byte_ends[first + 1 : self.parts + 1] = self.byte_ends[first] + np.cumsum([len(x) for x in new])
        self.bytes[self.byte_ends[first] : self.byte_ends[self.parts]] = np.frombuffer(b"".join(new), np.uint8)
        self.used += total

    def _whole(self, t: Texts) -> list[tuple[int, int]]:
        """Places of added tokens, found before any folding of case and never over a text's end."""
        raw = t.data.tobytes() if self.added else b""
        if not any(x in raw for x in self.added):
            return []
        found = re.compile(b"|".join(map(re.escape, self.added)))
        return [m.span() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True) for m in found.finditer(raw, a, b)]

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        if self.parts > CACHE_PARTS or self.used > 16 * CACHE_PARTS:
            self._forget()
        seen = t if self.kind == "bytes" else Texts(LOWER[t.data], t.offsets, t.rows)
        start, end = part_ends(seen, self.kind, self._whole(t))
        size = end - start
        keys, checks = slice_hashes(seen.data, start, end), _heads(seen.data, start, size)
        at = self.table.find(keys, checks)
        found = np.flatnonzero(at >= 0)
        kept = self.byte_ends[at[found]]
        same = self.byte_ends[at[found] + 1] - kept == size[found]
        long = np.flatnonzero(same & (size[found] > 8))  # shorter ones are told by checks alone
        same[long] = _equal(seen.data, start[found[long]], self.bytes, kept[long], size[found[long]])
        other = found[~same]
        at[other] = -1
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, base = seen.data.tobytes(), self.parts
            distinct: dict[bytes, int] = {}
            at[new] = [base + distinct.setdefault(raw[a:b], len(distinct)) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self._learn(list(distinct))
            # into the table go parts that are not too long and whose hash no other part has
            apart = np.zeros(len(start), bool)
            apart[other] = True
            some = new[(size[new] <= LONGEST_KEPT) & ~apart[new]]
            _, first = np.unique(keys[some], return_index=True)
            some = some[first]
            self.table.add(keys[some], checks[some], at[some])
        n = self.ends[at + 1] - self.ends[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(before[-1]) + np.repeat(self.ends[at] - before[:-1], n)]
        return ids, np.diff(before[np.searchsorted(start, t.offsets)])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with places for n entries at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at:at + size] equals b[bt:bt + size], for many places."""
    same = a[spans(at, at + size - 1)] == b[spans(bt, bt + size - 1)]
    out = np.ones(len(at), bool)
    out[np.repeat(np.arange(len(at)), size)[~same]] = False
    return out


def _heads(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each part, with its length in what is left over or above them."""
    words = eights(data)[start]
    keep = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
    mask = np.where(keep == 64, ~np.uint64(0), (np.uint64(1) << (keep % np.uint64(64))) - np.uint64(1))
    return (words & mask) + (size.astype(np.uint64) << np.uint64(56))


_ENCODERS: dict = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, made once."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind, added=True)
    return _ENCODERS[path, kind]
