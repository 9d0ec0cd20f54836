"""An index for substring search: which blocks of a table hold which runs of three characters.

A table is written in blocks, ranges of an order, each a folder of files. Its postings say of each run of three characters, in
lower case, in which blocks it stands; they lie in buckets by a hash of the run. A search looks up its pattern's runs, reads
the blocks that have them all, and applies the exact pattern there. A pattern without a run of three literal characters
reads all blocks. What the postings hold grows with the number of blocks, not of rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuts import small_batches

GRAM = 3
BUCKETS = 64


#: Characters whose runs are looked at in one step.
CHARS = 1_000_000


def runs(texts: list[str], n: int = GRAM):
    """(joined, owner, at, key) of all runs of n characters, in steps of CHARS characters or about: the step's text, and of each run its text's number, its place in joined and a number of its own, the same in all steps for three characters and fewer."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - n + 1), CHARS):
            held.append((i, t[a : a + CHARS + n - 1]))
            size += len(held[-1][1])
            if size >= CHARS:
                yield _runs(held, n)
                held, size = [], 0
    if held:
        yield _runs(held, n)


def _runs(held: list[tuple[int, str]], n: int):
    joined = "".join(x for _, x in held)
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    length = np.array([len(x) for _, x in held])
    at = np.flatnonzero(np.arange(len(code)) + n <= np.repeat(np.cumsum(length), length))
    key = code[at]
    for j in range(1, n):
        if j > 2:
            key = np.unique(key, return_inverse=True)[1]
        key = (key << 21) | code[at + j]
    return joined, np.repeat([i for i, _ in held], length)[at], at, key


def block_grams(rows: DataFrame, texts: list[Column]) -> DataFrame:
    """(block, gram) of the runs of three characters of rows' texts in lower case, distinct within a batch of a task."""
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            block = np.array(batch.column(0).to_pylist(), np.int64)
            found: dict[int, set[str]] = {}
            for column in batch.columns[1:]:
                for joined, owner, at, key in runs([x or "" for x in column.to_pylist()]):
                    for b in np.unique(block[owner]).tolist():
                        mine = np.flatnonzero(block[owner] == b)
                        first = np.unique(key[mine], return_index=True)[1]
                        found.setdefault(b, set()).update(joined[i : i + GRAM] for i in at[mine[first]].tolist())
            for b, held in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(held), pa.int32()), pa.array(list(held), pa.string())], names=["block", "gram"])

    return rows.select("block", *[F.lower(t).alias(f"_{i}") for i, t in enumerate(texts)]).mapInArrow(run, "block int, gram string")


def literal_runs(pattern: str) -> list[str]:
    """The runs of literal characters in a LIKE pattern, whose wildcards a backslash makes literal."""
    runs, i = [""], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            i += 1
            runs[-1] += pattern[i]
        elif pattern[i] in "%_":
            runs.append("")
        else:
            runs[-1] += pattern[i]
        i += 1
    return [r for r in runs if r]


def write_blocks(rows: DataFrame, path: str, order: list[str], texts: list[Column], blocks: int, buckets: int = BUCKETS) -> None:
    """Writes rows under path in blocks by order, and the postings of their texts (null texts have no runs)."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    placed.write.partitionBy("block").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    postings = block_grams(stored, texts).distinct()
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    postings.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")


def blocks_with(spark: SparkSession, path: str, pattern: str, buckets: int = BUCKETS) -> list[int] | None:
    """The blocks in which a LIKE pattern without regard to case may match; null if it tells nothing."""
    low = spark.range(1).select(F.array(*[F.lower(F.lit(r)) for r in literal_runs(pattern)]).cast("array<string>").alias("r")).first().r  # of one pattern
    found = sorted({r[i : i + GRAM] for r in low for i in range(len(r) - GRAM + 1)})
    asked = spark.createDataFrame([(g,) for g in found], "gram string").select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket")).collect()
    if not asked:
        return None
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*{r.bucket for r in asked}) & F.col("gram").isin(*[r.gram for r in asked]))
    return sorted(r.block for r in postings.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked)).collect())  # a row for each block at most


def pruned(spark: SparkSession, path: str, *patterns: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the blocks in which all of the patterns may match; the exact patterns are still to be applied."""
    rows, left = spark.read.parquet(f"{path}/rows"), None
    for pattern in patterns:
        blocks = blocks_with(spark, path, pattern, buckets)
        if blocks is not None:
            left = set(blocks) if left is None else left & set(blocks)
    return (rows if left is None else rows.filter(F.col("block").isin(*sorted(left)) if left else F.lit(False))).drop("block")
