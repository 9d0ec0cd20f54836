"""Blocks of documents, and exchanges in which every block sends a sorted list of hashes to ranges of the hash space.

A block is some megabytes of documents, dealt by a hash of doc_id and text, so that rows without a doc_id, or of one, are spread too. It sends each distinct hash once, with a mark if it has
it twice or more; so a hash that millions of documents share reaches a range once for each block at most. A range answers
each block about its own hashes only. Nothing passes through the driver or a single task, and no answer is broadcast.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, and hashes that meet in a range.
BLOCK_BYTES = 6_000_000
RANGE_HASHES = 3_000_000


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def block_of(doc_id: Column, text_key: Column, total: int, block_bytes: int) -> Column:
    """The block of a row, of as many as total bytes make; text_key: as text_key()."""
    return F.pmod(F.xxhash64(doc_id, text_key), F.lit(max(1, -(-total // block_bytes)))).cast("int")


def text_key() -> Column:
    return F.xxhash64("text")


def deal(docs: DataFrame, total: int, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """(block, doc_id, text) of all rows, and the columns named in keep as _x0, _x1 and so on. A plan that uses it more than once shuffles the texts once."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(block_of(doc_id, text_key(), total, block_bytes).alias("block"), doc_id.alias("doc_id"), "text", *[F.col(x).alias(f"_x{i}") for i, x in enumerate(keep or [])])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which of them occur twice or more."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys))) > 1


def cut(keys: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """Where sorted keys of so many bits pass from one range to the next: ranges + 1 places."""
    limits = [(i << bits) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(limits, np.uint64)), [len(keys)]]).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted integers as differences in the fewest bytes that hold them all: 1 byte of width, the first key, the rest."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    most = int(steps.max()) if len(steps) else 0
    width = next(w for w in (2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    steps = np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), steps]), dtype=np.uint64)


def flags(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unflagged(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def member(sorted_keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of asked are in sorted_keys."""
    if not len(sorted_keys):
        return np.zeros(len(asked), bool)
    at = np.searchsorted(sorted_keys, asked)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == asked


def twice(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Distinct keys, sorted, that occur twice or more or once with a mark."""
    order = np.argsort(keys, kind="stable")
    keys, marks = keys[order], marks[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return keys
    return keys[at[np.add.reduceat(1 + marks.astype(np.int64), at) > 1]]


def table(columns: dict, types: dict) -> pa.Table:
    return pa.table({k: pa.array(v, types[k]) for k, v in columns.items()})


def column(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()
