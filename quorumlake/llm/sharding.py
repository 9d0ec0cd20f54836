"""Sharding (operator 9): contiguous shards of near equal bytes, by DataFrame operations only.

Documents stand in the order of doc_id (nulls first; equal ids by checksum). A global prefix sum of their sizes, made
from totals of partitions, is cut at equal targets: a document belongs to the shard in which its middle byte lies. No
shard differs from the mean by more than the longest document.

Defined results: a null or empty text has size 1. Equal texts and repeated rows are documents like others. A document
longer than a shard's target may leave a shard empty. An empty table gives no rows; other columns do not matter.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import positions


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, start (bytes of all documents before), shard and slot (from 0 in each shard)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.lit(1).cast("long").alias("one"))
    placed = positions(sized, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], {"start": "size", "row": "one"}, name="shards")
    total = placed.agg(F.max(F.col("start") + F.col("size")).alias("total"))  # one row
    cut = F.least(F.lit(shards - 1), F.floor((2 * F.col("start") + F.col("size")) * shards / (2 * F.col("total"))).cast("int"))
    sharded = placed.crossJoin(F.broadcast(total)).withColumn("shard", cut)
    firsts = sharded.groupBy(F.col("shard").alias("of_shard")).agg(F.min("row").alias("first"))  # one row for each shard
    return sharded.join(F.broadcast(firsts), F.col("shard") == F.col("of_shard")).select("doc_id", "size", "text_crc32", "start", "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """docs as Parquet, a folder for each shard, rows in the order of their slots. Needs doc_id to be unique."""
    where = shard_by_bytes(docs, shards).select("doc_id", "shard", "slot")
    docs.join(where, "doc_id").repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
