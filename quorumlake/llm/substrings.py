"""Substring dedup (operator 3): runs of words that occur more than once, by a count-min prefilter and exact grouping.

Each block of documents makes a count-min sketch of its windows: two rows of counters, stored sparsely as sorted cell
numbers, saturating at two. Sketches are merged range by range of the cells, in parallel; the rows' width follows the
number of windows. Every block gets back which of its own cells count two or more. Such counts overestimate: a window all
of whose cells do is estimated repeated, and none that is repeated is lost. A second pass groups only those windows, by 128
bits of hash, and tells each block which of its estimates were wrong.

Defined results: a null or empty text, and one shorter than a window, loses nothing. Equal rows are documents that repeat
each other. Windows never cross documents; a document of any length is handled whole by its block. An empty table gives
no rows; further columns do not matter.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import RANGE_HASHES, column, cut, deal, distinct, flags, member, packed, table, text_bytes, twice, unflagged, unpacked
from .storage import small_batches
from .textkernel import Texts, covered, mix, steps, windows

DEPTH = 2
#: Counters in a row for each byte of text (about 6 bytes of text make a window), before rounding up to a power of two.
CELLS_PER_BYTE = 1.0
_SALT = np.uint64(0x2545F4914F6CDD1D)

SENT = "kind int, slice int, block int, keys binary, more binary, marks binary"
SENT_TYPES = {"kind": pa.int32(), "slice": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "more": pa.binary(), "marks": pa.binary()}
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes + np.uint64(row + 1) * _SALT) >> np.uint64(64 - bits)


def _hashes(t: Texts, width: int, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    doc = t.words()[2]
    at, one = windows(t.word_hashes(0), doc, width)
    return at, one, windows(t.word_hashes(1), doc, width)[1] if second else None


def _no(rows: list) -> pa.Table:
    return table({k: [r[i] for r in rows] for i, k in enumerate(SENT_TYPES)}, SENT_TYPES)


def repeated_windows(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Dealt documents, the answers to their blocks (kind 0: cells that count two or more; kind 1: wrong estimates), bits of a cell, ranges."""
    small_batches(docs.sparkSession)
    total = text_bytes(docs)
    bits = max(20, min(60, int(np.ceil(np.log2(max(1, total * CELLS_PER_BYTE))))))
    slices = max(1, -(-total // (6 * RANGE_HASHES)))
    dealt = deal(docs, total)

    def sketch(t: pa.Table) -> pa.Table:
        block, rows = column(t, "block")[0], []
        found = [_hashes(x, width, False)[1] for x in steps(t.column("text"))]
        hashes = np.concatenate(found)
        for row in range(DEPTH):
            cells, marks = distinct(_cells(hashes, row, bits))
            at = cut(cells, slices, bits)
            rows += [(0, row * slices + i, block, packed(cells[a:b]), None, flags(marks[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        return _no(rows)

    def merge(t: pa.Table) -> pa.Table:
        blocks, part = column(t, "block"), column(t, "slice")[0]
        keys = [unpacked(x) for x in column(t, "keys")]
        marks = [unflagged(x, len(k)) for x, k in zip(column(t, "marks"), keys, strict=True)]
        many = twice(np.concatenate(keys), np.concatenate(marks))
        own = [k[member(many, k)] for k in keys]
        return _no([(0, part, b, packed(k), None, None) for b, k in zip(blocks, own, strict=True) if len(k)])

    cells = dealt.groupBy("block").applyInArrow(sketch, SENT).groupBy("slice").applyInArrow(merge, SENT)

    def estimated(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _no([])
        block, counted = column(left, "block")[0], Counted(right, slices)
        found = []
        for x in steps(left.column("text")):
            _, one, two = _hashes(x, width, True)
            maybe = counted.estimate(one, bits)
            found.append(np.stack([one[maybe], two[maybe]]))
        one, two = np.concatenate(found, axis=1)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        first = np.ones(len(one), bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        at = np.flatnonzero(first)
        marks = np.diff(np.append(at, len(one))) > 1
        one, two = one[at], two[at]
        at = cut(one, slices)
        return _no([(1, i, block, one[a:b].tobytes(), two[a:b].tobytes(), flags(marks[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a])

    def exact(t: pa.Table) -> pa.Table:
        blocks, part = column(t, "block"), column(t, "slice")[0]
        one = [np.frombuffer(x, np.uint64) for x in column(t, "keys")]
        two = np.concatenate([np.frombuffer(x, np.uint64) for x in column(t, "more")])
        marks = np.concatenate([unflagged(x, len(k)) for x, k in zip(column(t, "marks"), one, strict=True)])
        of = np.repeat(np.arange(len(one)), [len(x) for x in one])
        one = np.concatenate(one)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        single = np.bincount(group, 1 + marks[order])[group] == 1
        alone = order[single]
        return _no([(1, part, blocks[i], np.sort(one[alone[of[alone] == i]]).tobytes(), None, None) for i in np.unique(of[alone]).tolist()])

    sent = dealt.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(estimated, SENT)
    wrong = sent.groupBy("slice").applyInArrow(exact, SENT)
    return dealt, cells.unionByName(wrong), bits, slices


class Counted:
    """A block's answers."""

    def __init__(self, answers: pa.Table, slices: int):
        rows = sorted(zip(*[column(answers, x) for x in ("kind", "slice", "keys")], strict=True), key=lambda x: x[:2])
        none = np.zeros(0, np.uint64)
        self.rows = [np.concatenate([none, *[unpacked(k) for kind, s, k in rows if kind == 0 and s // slices == row]]) for row in range(DEPTH)]
        self.wrong = np.sort(np.concatenate([none, *[np.frombuffer(k, np.uint64) for kind, _, k in rows if kind == 1]]))

    def estimate(self, hashes: np.ndarray, bits: int) -> np.ndarray:
        maybe = np.flatnonzero(member(self.rows[0], _cells(hashes, 0, bits)))
        for row in range(1, DEPTH):
            maybe = maybe[member(self.rows[row], _cells(hashes[maybe], row, bits))]
        return maybe

    def repeated(self, hashes: np.ndarray, bits: int) -> np.ndarray:
        maybe = self.estimate(hashes, bits)
        return maybe[~member(self.wrong, hashes[maybe])]


def remove_repeats(docs: DataFrame, width: int = 35, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (words left, one space between; null if texts is false) of each row.

    Each word covered by a window of width words that starts anywhere else too is removed, at all its places.
    """
    dealt, answers, bits, slices = repeated_windows(docs, width)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        counted, rows = Counted(right, slices), []
        ids, done = column(left, "doc_id") if left.num_rows else [], 0
        for t in steps(left.column("text")) if left.num_rows else ():
            doc = t.words()[2]
            at, one, _ = _hashes(t, width, False)
            gone = covered(len(doc), at[counted.repeated(one, bits)], width)
            first = np.searchsorted(doc, np.arange(t.count + 1))
            raw = t.data.tobytes()
            for i in range(t.count):
                words, lost = raw[t.offsets[i] : t.offsets[i + 1]].split(), gone[first[i] : first[i + 1]]
                n = int(lost.sum())
                kept = b" ".join(compress(words, (~lost).tolist()) if n else words)
                rows.append((ids[done + i], len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            done += t.count
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({k: pa.array([r[i] for r in rows], types[i]) for i, k in enumerate(names)})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, RESULT)
