"""Suffix-array dedup (operator 1): byte strings of a length that occur more than once, by hash-compared suffix sorting.

Sorting every suffix of a corpus would move eight bytes or more for each byte of text. Only suffixes that may have an equal
start need sorting, and content tells which: of the GRAM-byte strings inside each window of the length, the one with the
least hash is the window's anchor. Equal windows have equal anchors at equal places.

1. Blocks of documents exchange their anchors' hashes; anchors that occur once are dropped, and all their windows with them.
2. A run of windows of one document with one anchor makes a piece: the bytes that they cover, under three lengths long.
   Each block sends each distinct piece once, with its bytes, to the bucket of its anchor. Pieces that are equal throughout,
   bytes compared, are repeated as a whole. The suffixes that start in the others are sorted, those of an anchor together,
   by a mergesort that compares two suffixes by their longest common extension: a binary search over polynomial hashes of
   prefixes, so that a comparison takes a logarithmic number of steps. Neighbours whose extension reaches the length are
   repeated; their bytes are compared before that counts.
3. Each block learns which windows of its pieces are repeated, and removes the bytes that they cover.

An anchor with many distinct pieces (the rim of a passage that many documents share) would make its bucket large. Its pieces
are cut into cells of CELL windows by the anchor's place in the window, and a cell goes to the bucket of its anchor, its
number and the bytes that all of its windows have. Equal windows are in equal cells; pieces whose bytes differ outside the
rim of a cell part ways. Where the passage ends inside a cell's rim they do not: so blocks exchange the cells' keys as they
did the anchors', and a cell with many distinct pieces is cut into cells of FINE windows by the same rule. Those of one key
differ in FINE - 1 bytes at most, so that there are no more than 256 of them, however many documents share the passage.
Cells are sorted and compared like other pieces: the number MANY_PIECES decides how much meets in a bucket, not what is found.

Defined results: a null or empty text, and one shorter than the length, loses nothing. Equal rows repeat each other.
Strings never cross documents. Bytes that are left may end inside a character of UTF-8; kept_text drops the remains of such
a character. A document of any length is handled whole by its block. An empty table gives no rows; further columns do not
matter.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import RANGE_HASHES, column, cut, deal, flags, member, packed, text_bytes, twice, unflagged, unpacked
from .storage import small_batches
from .textkernel import BYTE_BASES, Prefixes, Rolling, Texts, mix, spans, steps

LENGTH = 400
GRAM = 64
#: Distinct pieces of an anchor, over all blocks, beyond which they are cut into cells (a multiple of FINE windows each).
MANY_PIECES = 300
CELL = 32
#: Windows in what a cell with as many distinct pieces is cut into.
FINE = 2
#: Bits of a place in a text; the rest of 64 are those of a gram's hash, the same for every text.
PLACE_BITS = 36
#: Bytes of text for each bucket of pieces.
BUCKET_BYTES = 8_000_000
#: Suffixes that are sorted at a time, whole anchors together.
SORT_SUFFIXES = 300_000

SENT = "kind int, slice int, block int, a binary, b binary, c binary, d binary, marks binary"
_TYPES = {"kind": pa.int32(), "slice": pa.int32(), "block": pa.int32(), **{k: pa.binary() for k in ("a", "b", "c", "d", "marks")}}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.table({k: pa.array([r[i] for r in rows], _TYPES[k]) for i, k in enumerate(_TYPES)})


class Pieces:
    """The pieces of some texts: first and last window start (last included), anchor's place, and key, by which pieces meet."""

    def __init__(self, t: Texts, length: int, gram: int):
        self.t, self.length = t, length
        n, width = len(t.data), length - gram + 1
        none = np.zeros(0, np.int64)
        self.first = self.last = self.place = none
        self.key = np.zeros(0, np.uint64)
        if n < length:
            return
        self.rolling = Rolling(t.data)
        hashes = self.rolling.grams(gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        best = _sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width)
        where = (best & low).astype(np.int64)
        doc_end = np.repeat(t.offsets[1:], np.diff(t.offsets))[: len(where)]
        start = np.flatnonzero(np.arange(len(where)) + length <= doc_end)
        if not len(start):
            return
        at = where[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        # windows of two documents never share an anchor, for it lies inside the window
        self.first = start[new]
        self.last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
        self.place = at[new]
        self.key = mix(~hashes[self.place])  # least hashes lie close together; these are spread evenly

    def kinds(self) -> np.ndarray:
        """A number for each piece, nearly always the same for the same bytes only: to count them."""
        return self.rolling.of(self.first, self.last + self.length) if len(self.first) else self.key

    def _cells(self, some: np.ndarray, raw: bytes, size: int) -> tuple[np.ndarray, ...]:
        """The pieces numbered by some, cut into cells of size windows: first and last window, anchor's place, and key."""
        # windows from the first to the last have their anchor at places from high down to low
        low, high = (self.place[some] - self.last[some]) // size, (self.place[some] - self.first[some]) // size
        cell, of = spans(low, high), np.repeat(some, high - low + 1)
        upper = self.place[of] - cell * size  # the last window of a whole cell
        keys = [_digest(raw[b : b + self.length - size + 1] + k.to_bytes(8, "little") + c.to_bytes(8, "little"))[0] for b, k, c in zip(upper.tolist(), self.key[of].tolist(), cell.tolist(), strict=True)]
        return np.maximum(self.first[of], upper - size + 1), np.minimum(self.last[of], upper), self.place[of], np.array(keys, np.uint64)

    def cut(self, hot: np.ndarray, size: int, least: int = 0) -> None:
        """Cuts the pieces from the number least on whose key is hot into cells, which go to the end; their number is told by own."""
        some = least + np.flatnonzero(member(hot, self.key[least:]))
        rest = np.delete(np.arange(len(self.key)), some)
        cells = self._cells(some, self.t.data.tobytes(), size)
        self.own = len(rest)
        self.first, self.last, self.place, self.key = (np.append(x[rest], y) for x, y in zip((self.first, self.last, self.place, self.key), cells, strict=True))

    def keep(self, repeated: np.ndarray, hot: np.ndarray) -> None:
        """Leaves pieces of repeated anchors, cut into cells where their anchor is hot."""
        mine = np.flatnonzero(member(repeated, self.key))
        self.first, self.last, self.place, self.key = (x[mine] for x in (self.first, self.last, self.place, self.key))
        self.cut(hot, CELL)

    def only(self, repeated: np.ndarray, hot: np.ndarray, hot_cells: np.ndarray) -> list[bytes]:
        """Leaves pieces of repeated anchors, cut into cells where their anchor is hot, and those again where they are. Returns their bytes."""
        self.keep(repeated, hot)
        self.cut(hot_cells, FINE, self.own)
        raw = self.t.data.tobytes()
        return [raw[a:b] for a, b in zip(self.first.tolist(), (self.last + self.length).tolist(), strict=True)]


def _digest(raw: bytes) -> tuple[int, int]:
    """128 bits of hash."""
    x = int.from_bytes(hashlib.blake2b(raw, digest_size=16).digest(), "little")
    return x & (1 << 64) - 1, x >> 64


def _digests(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in pieces), "<u8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width entries in a row: running minima within stretches of that width, from both sides."""
    n = len(x)
    m = -(-n // width) * width
    y = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def common_extension(h: Prefixes, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest common start of the suffixes i and j, up to most, by binary search over prefix hashes."""
    low, high = np.zeros(len(i), np.int64), np.full(len(i), most, np.int64)
    while (high > low).any():
        middle = (low + high + 1) >> 1
        same = h.of(i, i + middle) == h.of(j, j + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def same_bytes(data: np.ndarray, i: np.ndarray, j: np.ndarray, length: np.ndarray | int, step: int = 1_000_000) -> np.ndarray:
    """Whether data[i:i + length] equals data[j:j + length], for many i and j."""
    length = np.broadcast_to(np.asarray(length, np.int64), i.shape)
    out = np.ones(len(i), bool)
    ends = np.cumsum(length)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
        p, q = spans(i[a:b], i[a:b] + length[a:b] - 1), spans(j[a:b], j[a:b] + length[a:b] - 1)
        bad = np.repeat(np.arange(a, b), length[a:b])[data[p] != data[q]]
        out[bad] = False
        a = b
    return out


def sort_suffixes(data: np.ndarray, h: Prefixes, suffix: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of suffixes by group, and within a group by their first `most` bytes: a mergesort of all groups at once.

    Two sorted runs are merged by finding each entry's place in the other run by binary search. Every comparison is a
    common extension by prefix hashes and one byte after it.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    begins = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(g)))
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    inside = np.arange(len(g)) - begin

    def less(i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = common_extension(h, i, j, most)
        end = n == most
        n = np.where(end, 0, n)
        return np.where(end, or_equal, data[i + n] < data[j + n])

    run = 1
    while run < (sizes.max() if len(sizes) else 0):
        active = np.flatnonzero(size > run)
        k = inside[active]
        left = (k // run) % 2 == 0
        pair = k // (2 * run) * (2 * run)
        other = np.where(left, pair + run, pair)  # the other run of the pair
        low = np.minimum(other, size[active])
        high = np.minimum(other + run, size[active])
        bottom = low.copy()
        mine = suffix[order[active]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            theirs = suffix[order[begin[active[open_]] + middle]]
            before = less(theirs, mine[open_], ~left[open_])  # entries of the left run go first among equals
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        own = k - np.where(left, pair, pair + run)
        place = begin[active] + pair + own + (low - bottom)
        merged = order.copy()
        merged[place] = order[active]
        order = merged
        run *= 2
    return order


def _rank_rows(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by keys, and for each row in that order whether it starts a new value."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, new


def repeated_in_bucket(data: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, anchor: np.ndarray, one: np.ndarray, two: np.ndarray, marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows in pieces that met in a bucket: piece, first and last window, counted inside the piece.

    start: where in data a piece's bytes are; count: its windows; offset: from its first window to the anchor.
    """
    order, new = _rank_rows(anchor, one, two, count, offset)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    head = order[new]  # one of each distinct piece
    same = same_bytes(data, start, start[head][which], count + length - 1)
    if not same.all():  # a collision: such pieces stand for themselves
        odd = np.flatnonzero(~same)
        which[odd] = len(head) + np.arange(len(odd))
        head = np.concatenate([head, odd])
    copies = np.bincount(which, 1 + marks, len(head))
    whole = copies > 1
    # suffixes of the distinct pieces of anchors that have more than one
    by_anchor, group = np.unique(anchor[head], return_inverse=True)
    several = np.flatnonzero(np.bincount(group, minlength=len(by_anchor))[group] > 1)
    hits, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    several = several[np.argsort(group[several], kind="stable")]
    starts = np.flatnonzero(np.append(True, group[several][1:] != group[several][:-1])) if len(several) else np.zeros(0, np.int64)
    ahead = np.append(0, np.cumsum(count[head[several]]))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ahead[starts], ahead[starts[i]] + SORT_SUFFIXES, "right")) - 1) if i + 1 < len(starts) else i + 1
        some = several[starts[i] : starts[j] if j < len(starts) else len(several)]
        p = head[some]
        size = count[p] + length - 1
        own = data[spans(start[p], start[p] + size - 1)]
        at = np.cumsum(size) - size
        suffix, of = spans(at, at + count[p] - 1), np.repeat(np.arange(len(p)), count[p])
        window = suffix - at[of]
        found = repeated_suffixes(own, suffix, group[some][of] * (1 << 20) + (offset[p][of] - window), length)  # equal windows have their anchor at the same place
        found &= ~whole[some][of]
        hits.append(window[found])
        owners.append(some[of[found]])
        i = j
    hit, owner = np.concatenate(hits), np.concatenate(owners)
    piece = np.concatenate([np.flatnonzero(whole), owner])
    first = np.concatenate([np.zeros(int(whole.sum()), np.int64), hit])
    last = np.concatenate([count[head[whole]] - 1, hit])
    order = np.lexsort((first, piece))
    piece, first, last = piece[order], first[order], last[order]
    if len(piece):
        new = np.append(True, (piece[1:] != piece[:-1]) | (first[1:] != last[:-1] + 1))
        at = np.flatnonzero(new)
        piece, first, last = piece[at], first[at], last[np.append(at[1:], len(piece)) - 1]
    # to each piece that a block has sent
    lo, hi = np.searchsorted(piece, which), np.searchsorted(piece, which, "right")
    each = spans(lo, hi - 1)
    return np.repeat(np.arange(len(which)), hi - lo), first[each], last[each]


def repeated_suffixes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share their first length bytes with another one of their group."""
    h = Prefixes(data, BYTE_BASES[0])
    order = sort_suffixes(data, h, suffix, group, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    near = near[common_extension(h, suffix[a[near]], suffix[b[near]], length) == length]
    near = near[same_bytes(data, suffix[a[near]], suffix[b[near]], length)]
    out = np.zeros(len(suffix), bool)
    out[a[near]] = out[b[near]] = True
    return out


def _raw(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x).astype(kind).tobytes()


def _from(raw: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(raw or b"", kind)


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True, gram: int = GRAM, many: int = MANY_PIECES, keep: list[str] | None = None) -> DataFrame:
    """RESULT of each row, and the columns of docs named in keep; kept_text is null if texts is false. Each byte of a string of length bytes that starts anywhere else too is removed, at all its places."""
    small_batches(docs.sparkSession)
    total = text_bytes(docs)
    slices = max(1, -(-total // (100 * RANGE_HASHES)))
    buckets = max(1, -(-total // BUCKET_BYTES))
    keep = keep or []
    dealt = deal(docs, total, keep=keep)

    def counted(block: int, kind: int, found: list[np.ndarray]) -> pa.Table:
        """A block's keys, which of them it has twice or more, and the number of distinct pieces of each; found: keys and pieces' numbers."""
        keys, one = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
        if not len(keys):
            return _sent([])
        order, new = _rank_rows(keys, one)
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.diff(np.append(at, len(keys)))
        different = np.add.reduceat(new.astype(np.int64), at)
        keys, marks = keys[at], total > 1
        places = cut(keys, slices)
        return _sent([(kind, i, block, packed(keys[a:b]), _raw(np.minimum(different[a:b], 65535), "<u2"), None, None, flags(marks[a:b])) for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)) if b > a])

    def anchors(t: pa.Table) -> pa.Table:
        each = (Pieces(x, length, gram) for x in steps(t.column("text")))
        return counted(column(t, "block")[0], 0, [np.stack([p.key, p.kinds()]) for p in each])

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        (repeated, hot, _), found = _anchors(right), []
        for x in steps(left.column("text")) if left.num_rows and len(hot) else ():
            p = Pieces(x, length, gram)
            p.keep(repeated, hot)
            found.append(np.stack([p.key, p.kinds()])[:, p.own :])
        return counted(column(left, "block")[0], 2, found) if found else _sent([])

    def meet(t: pa.Table) -> pa.Table:
        kind, blocks, part = column(t, "kind")[0], column(t, "block"), column(t, "slice")[0]
        keys = [unpacked(x) for x in column(t, "a")]
        marks = [unflagged(x, len(k)) for x, k in zip(column(t, "marks"), keys, strict=True)]
        every = np.concatenate(keys)
        repeated = twice(every, np.concatenate(marks))
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
        sums = np.add.reduceat(np.concatenate([_from(x, "<u2") for x in column(t, "b")]).astype(np.int64)[order], first)
        hot = every[order][first][sums > many]
        rows = []
        for b, k in zip(blocks, keys, strict=True):
            own = k[member(repeated, k)] if kind == 0 else np.zeros(0, np.uint64)
            crowded = k[member(hot, k)]
            if len(own) or len(crowded):
                rows.append((kind, part, b, packed(own), packed(crowded), None, None, None))
        return _sent(rows)

    told = dealt.groupBy("block").applyInArrow(anchors, SENT).groupBy("slice").applyInArrow(meet, SENT)
    common = told.unionByName(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cells, SENT).groupBy("slice").applyInArrow(meet, SENT))

    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sent([])
        block, hot = column(left, "block")[0], _anchors(right)
        seen: dict[tuple, int] = {}
        rows, texts_ = [], []
        for x in steps(left.column("text")):
            p = Pieces(x, length, gram)
            own = p.only(*hot)
            for raw, key, count, offset in zip(own, p.key.tolist(), (p.last - p.first + 1).tolist(), (p.place - p.first).tolist(), strict=True):
                one, two = _digest(raw)
                if (at := seen.get((one, two, key))) is None:
                    seen[one, two, key] = len(rows)
                    rows.append([key, one, two, count, offset, False])
                    texts_.append(raw)
                else:
                    rows[at][5] = True
        out = []
        if rows:
            key, one, two, count, offset, marks = (np.array(c, k) for c, k in zip(zip(*rows, strict=True), ("u8", "u8", "u8", "i4", "i4", "?"), strict=True))
            order = np.argsort(key, kind="stable")
            places = cut(key[order], buckets)
            for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
                if b > a:
                    o = order[a:b]
                    out.append((1, i, block, _raw(np.stack([key[o], one[o], two[o]]), "<u8"), _raw(np.stack([count[o], offset[o]]), "<i4"), b"".join(texts_[j] for j in o.tolist()), None, flags(marks[o])))
        return _sent(out)

    def bucket(t: pa.Table) -> pa.Table:
        blocks, part = column(t, "block"), column(t, "slice")[0]
        keys = [_from(x, "<u8").reshape(3, -1) for x in column(t, "a")]
        marks = np.concatenate([unflagged(x, k.shape[1]) for x, k in zip(column(t, "marks"), keys, strict=True)])
        of = np.repeat(np.array(blocks), [k.shape[1] for k in keys])
        key, one, two = np.concatenate(keys, axis=1)
        count, offset = np.concatenate([_from(x, "<i4").reshape(2, -1) for x in column(t, "b")], axis=1).astype(np.int64)
        data = np.frombuffer(b"".join(column(t, "c")), np.uint8)
        size = count + length - 1
        start = np.cumsum(size) - size
        piece, first, last = repeated_in_bucket(data, start, count, offset, key, one, two, marks, length)
        order = np.argsort(of[piece], kind="stable")
        piece, first, last = piece[order], first[order], last[order]
        places = np.append(np.flatnonzero(np.append(True, of[piece][1:] != of[piece][:-1])), len(piece)) if len(piece) else [0]
        out = []
        for a, b in zip(places[:-1], places[1:], strict=True):
            out.append((1, part, int(of[piece[a]]), _raw(np.stack([one[piece[a:b]], two[piece[a:b]]]), "<u8"), _raw(np.stack([first[a:b], last[a:b]]), "<i4"), None, None, None))
        return _sent(out)

    sent = dealt.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(pieces, SENT)
    answers = common.unionByName(sent.groupBy("slice").applyInArrow(bucket, SENT))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, done = [], 0
        ids = column(left, "doc_id") if left.num_rows else []
        hot, found = _anchors(right), _repeated(right)
        for x in steps(left.column("text")) if left.num_rows else ():
            gone = np.zeros(len(x.data) + 1, np.int32)
            if len(hot[0]):
                p = Pieces(x, length, gram)
                one, two = _digests(p.only(*hot))
                lo, hi = np.searchsorted(found[0], one), np.searchsorted(found[0], one, "right")
                each, owner = spans(lo, hi - 1), np.repeat(np.arange(len(one)), hi - lo)
                right_ = found[1][each] == two[owner]
                each, owner = each[right_], owner[right_]
                base = p.first[owner]
                np.add.at(gone, base + found[2][each], 1)
                np.add.at(gone, base + found[3][each] + length, -1)
            lost = np.cumsum(gone[:-1]) > 0
            for i in range(x.count):
                a, b = x.offsets[i], x.offsets[i + 1]
                mine = lost[a:b]
                n = int(mine.sum())
                kept = (x.data[a:b][~mine] if n else x.data[a:b]).tobytes()
                spans_ = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0
                rows.append((ids[done + i], int(b - a), n, spans_, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None))
            done += x.count
        names = [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()] * 2
        kept = {f"_x{i}": left.column(f"_x{i}") for i in range(len(keep))} if left.num_rows else {}
        return pa.table({k: pa.array([r[i] for r in rows], types[i]) for i, k in enumerate(names)} | kept)

    if keep:
        result = RESULT + "".join(f", _x{i} {docs.schema[x].dataType.simpleString()}" for i, x in enumerate(keep))
        out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, result)
        return out.select(*[f.split()[0] for f in RESULT.split(", ")], *[F.col(f"_x{i}").alias(x) for i, x in enumerate(keep)])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, RESULT)


def _anchors(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's repeated anchors, those with very many pieces, and the cells with very many, sorted."""
    rows = sorted((k, s, a, b) for k, s, a, b in zip(*[column(answers, c) for c in ("kind", "slice", "a", "b")], strict=True) if k != 1)
    none = np.zeros(0, np.uint64)
    every = lambda kind, i: np.concatenate([none, *[unpacked(r[i]) for r in rows if r[0] == kind]])
    return every(0, 2), every(0, 3), every(2, 3)


def _repeated(answers: pa.Table) -> list[np.ndarray]:
    """A block's repeated runs of windows in pieces (piece hashes, first, last), by hash."""
    rows = list(zip(*[column(answers, c) for c in ("kind", "a", "b")], strict=True))
    keys = np.concatenate([np.zeros((2, 0), np.uint64), *[_from(a, "<u8").reshape(2, -1) for k, a, _ in rows if k == 1]], axis=1)
    runs = np.concatenate([np.zeros((2, 0), np.int64), *[_from(b, "<i4").reshape(2, -1) for k, _, b in rows if k == 1]], axis=1)
    order = np.argsort(keys[0], kind="stable")
    return [keys[0][order], keys[1][order], runs[0][order], runs[1][order]]
