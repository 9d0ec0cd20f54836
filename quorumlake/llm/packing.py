"""Packing (operator 2): power-of-two decomposition of documents.

A document's ids (with the end id) are cut into pieces whose lengths are powers of two: as many of the full length as
fit, then one for each binary digit of the rest, longest first. Each piece is a sequence of its own: none crosses
documents, none needs padding, and sequences of equal length (column length) form a bucket that trains as one batch
shape. The pass over the documents shuffles nothing.

Defined results: a null or empty text gives one piece, the end id. Repeated rows and equal doc_ids are packed row by row,
and their pieces differ in sequence_id. A very long text is tokenised whole and its pieces leave in batches. Other
columns do not matter; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .textkernel import STEP_BYTES, steps
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Ids that leave in one Arrow batch.
BATCH_IDS = 250_000


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, largest first, that sum to n; none is over longest, itself a power of two."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n >> k & 1]


def tokenised(batches, path: str, kind: str, end_id: int, step_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts of the batches with the ids of their texts on end, each text's with end_id, and the number of ids of each."""
    for batch in batches:
        for t in steps(batch.column("text"), step_bytes):
            cut = batch.slice(t.rows.start, t.count)
            ids, counts = encoder(path, kind).encode(t)
            ends = np.cumsum(counts)
            yield cut, np.insert(ids, ends, end_id).astype("<u4"), counts + 1


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "words", end_id: int = 2, longest: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (always 0).

    sequence_id is unique; it holds the partition in its upper bits, so that numbering needs no pass of its own.
    """
    small_batches(docs.sparkSession)

    def pieces(batches):
        for cut, ids, counts in tokenised(batches, tokenizer, kind, end_id):
            doc_ids, firsts = cut.column("doc_id"), np.concatenate([[0], np.cumsum(counts)])
            rows: list[tuple] = []
            held = 0
            for i, n in enumerate(counts.tolist()):
                start = 0
                for length in binary_lengths(n, longest):
                    at = firsts[i] + start
                    rows.append((i, start, length, ids[at : at + length].tobytes(), n))
                    start, held = start + length, held + length
                    if held >= BATCH_IDS:
                        yield _batch(doc_ids, rows)
                        rows, held = [], 0
            if rows:
                yield _batch(doc_ids, rows)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def _batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, start, length, ids, total = zip(*rows, strict=True)
    long = pa.int64()
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at)), pa.array(start, long), pa.array(length, long), pa.array(ids, pa.binary()), pa.array(total, long)], names=["doc_id", "start", "length", "ids", "doc_tokens"])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, a folder for each length: the buckets that batches are drawn from."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
