"""Token-id files (operator 4): frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus, most frequent first, so that common ids are small. Four ranks share a
control byte, two bits each for a rank's length of one to four bytes; control bytes and data bytes are kept in two streams,
so that numpy finds all lengths of a block by one look-up in a table of 256 rows and then gathers the data bytes.

Format: a folder of Parquet files without compression, which any store that Spark writes can hold. blocks/ has a row for
each block of whole documents in ascending doc_id: block (its place in the order), doc_ids, starts, counts, control and
data. ranks/ has a row for each id: rank, id, n. A document longer than a block's ids makes a block of its own.

Defined results: a null or empty text is the end id alone. Equal doc_ids stand in the order of a hash of their texts, null
doc_ids first. Other columns do not matter; an empty table gives empty folders.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import tokenised
from .storage import dropped, fit_partitions, new_path, small_batches, written

BLOCK_IDS = 20_000
#: Distinct ids, of which a table goes to the encoders: a vocabulary's size, not the corpus's.
MOST_IDS = 5_000_000

_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: Lengths of the four ranks of each control byte.
LENGTHS = (_CODES + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks (uint32)."""
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = length - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block, by table look-up."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < length[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str = "bytes", end_id: int = 0) -> None:
    """Tokenise docs and write the format above under path.

    The documents are range-partitioned by doc_id before they become ids; the ids are written once, so that counting and
    encoding read them without tokenising again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(fit_partitions(docs), *order).sortWithinPartitions(*order)
    runs = written(rows.select("doc_id", "text").mapInArrow(_blocks(tokenizer, kind, end_id), "part int, block int, before long, doc_ids array<long>, counts array<int>, total long, width int, ids binary"), "ids")
    ranks = written(_ranks(runs), "ranks")
    ranks.write.option("compression", "none").parquet(f"{path}/ranks")
    n = ranks.count()
    if n > MOST_IDS:
        raise ValueError(f"{n} distinct ids: more than a vocabulary has")
    by_id = ranks.select("id", "rank").toArrow()  # a vocabulary's size
    rank_of = np.zeros(int(by_id.column("id").to_numpy().max(initial=0)) + 1, np.uint32)
    rank_of[by_id.column("id").to_numpy()] = by_id.column("rank").to_numpy()
    ranks_ = spark.sparkContext.broadcast(rank_of)
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = runs.groupBy("part").agg(F.sum("total").alias("t"), F.count("*").alias("b"))
    firsts = firsts.select(F.col("part").alias("of"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("first"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("first_block"))
    # one row for each partition, of 20 bytes: broadcast, the ids stay where they are
    placed = runs.join(F.broadcast(firsts), F.col("part") == F.col("of")).withColumn("number", F.col("first_block") + F.col("block")).withColumn("start", F.col("first") + F.col("before"))

    def encode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                control, data = encode_ranks(ranks_.value[_ids(row)])
                counts = row.column("counts").flatten().to_numpy()
                starts = row.column("start")[0].as_py() + np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([row.column("number"), row.column("doc_ids"), pa.array([starts.tolist()], pa.list_(pa.int64())), row.column("counts"), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["block", "doc_ids", "starts", "counts", "control", "data"])

    out = placed.select("number", "doc_ids", "counts", "start", "width", "ids").mapInArrow(encode, "block long, doc_ids array<long>, starts array<long>, counts array<int>, control binary, data binary")
    out.write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(runs, ranks)


def _blocks(tokenizer: str, kind: str, end_id: int):
    def blocks(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        doc_ids, counts, ids = [], [], []
        total = before = 0

        def flush():
            one = np.concatenate(ids)
            one = one.astype("<u2") if one.max() < 1 << 16 else one
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([total], pa.int64()), pa.array([one.itemsize], pa.int32()), pa.array([one.tobytes()], pa.binary())], names=["part", "block", "before", "doc_ids", "counts", "total", "width", "ids"])

        for cut, got, n in tokenised(batches, tokenizer, kind, end_id):
            firsts = np.concatenate([[0], np.cumsum(n)])
            for i, doc_id in enumerate(cut.column("doc_id").to_pylist()):
                if total and total + n[i] > BLOCK_IDS:
                    yield flush()
                    block, before, total = block + 1, before + total, 0
                    doc_ids, counts, ids = [], [], []
                doc_ids.append(doc_id)
                counts.append(int(n[i]))
                ids.append(got[firsts[i] : firsts[i + 1]])
                total += int(n[i])
        if total:
            yield flush()

    return blocks


def _ids(row: pa.RecordBatch) -> np.ndarray:
    """The ids of a stored block, in two or four bytes each."""
    return np.frombuffer(row.column("ids")[0].as_buffer(), f"<u{row.column('width')[0].as_py()}")


def _ranks(runs: DataFrame) -> DataFrame:
    """rank, id and n of each id that occurs; the most frequent has rank 0, equal counts go by id."""

    def count(batches):
        sums = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                got = np.bincount(_ids(batch.slice(i, 1)))
                if len(got) > len(sums):
                    sums = np.concatenate([sums, np.zeros(len(got) - len(sums), np.int64)])
                sums[: len(got)] += got
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen])], names=["id", "n"])

    counts = runs.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "id")  # a row for each id of the vocabulary
    return counts.select((F.row_number().over(by_rank) - 1).alias("rank"), "id", "n")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toArrow()  # a vocabulary's size
    ids_of = spark.sparkContext.broadcast(by_rank.column("id").to_numpy().astype(np.uint32))
    small_batches(spark)

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = row.column("counts").flatten().to_numpy()
                ids = ids_of.value[decode_ranks(row.column("control")[0].as_py(), row.column("data")[0].as_py(), int(counts.sum()))]
                ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                raw = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), row.column("starts").flatten(), pa.array(counts, pa.int64()), raw], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{path}/blocks").select("doc_ids", "starts", "counts", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_file_path(spark: SparkSession) -> str:
    return new_path(spark, "tokens")
