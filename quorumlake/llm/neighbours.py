"""Approximate nearest neighbours (operator 10): shifted Hilbert curves.

Each ordering projects the vectors at random on a few orthogonal directions, shifts the box in which they lie, and sorts
them by their place on a Hilbert curve through it. The orderings are range-partitioned by Spark and cut into blocks of
equal numbers of vectors. A query is compared with all vectors in a window around its own place; the windows' nearest are
merged over blocks and orderings, and ranked by exact distances in double precision.

The window is a fixed share of all vectors, so that recall does not fall as the table grows. Queries (one row in a hundred)
are a stated set against all rows, in blocks of bounded size. Equal vectors are one point of the index, with the vec_ids
that can come among the nearest.

Defined results: vectors that are null, zero, of another length than most of a bounded sample, or hold null or non-finite
components take no part. Ties go to the smaller vec_id; repeated rows (equal vec_ids) count once. With fewer candidates
than asked for, all are returned. An empty table gives no rows; further columns do not matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions
from .storage import small_batches, written

ORDERINGS = 12
DIMENSIONS = 4
BITS = 10
#: Share of all vectors on either side of a query's place.
WINDOW = 1 / 16
#: Vectors in a block of an ordering; a window has at least as many on either side as WINDOW_LEAST.
BLOCK = 4096
WINDOW_LEAST = 256
#: Vectors that the box of the projections is fitted on: those of the least hashes of vec_id.
SAMPLE = 4000
SEED = 20240607


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (uint64, below 2 ** bits)."""
    x = cells.T.copy()
    dims, one = len(x), np.uint64(1)
    # from the coarsest bit down, undo the turns and swaps that the curve makes in each cell
    for b in range(bits - 1, 0, -1):
        bit = np.uint64(1 << b)
        below = bit - one
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Curves:
    """The orderings' projections and boxes, fitted on a sample."""

    def __init__(self, sample: np.ndarray, orderings: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, self.directions, self.low, self.scale = bits, [], [], []
        n = sample.shape[1]
        dims = min(dims, n)
        for _ in range(orderings):
            d = np.linalg.qr(rng.normal(size=(n, n)))[0][:, :dims]
            p = sample @ d
            low, high = p.min(0), p.max(0)
            wide = np.where(high > low, high - low, 1.0)
            # the box is half as wide again as the sample, and lies anywhere around it
            self.directions.append(d)
            self.low.append(low - wide * (0.05 + 0.4 * rng.random(dims)))
            self.scale.append((1 << bits) / (1.5 * wide))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        top = (1 << self.bits) - 1
        return [hilbert(np.clip((vectors @ d - low) * scale, 0, top).astype(np.uint64), self.bits) for d, low, scale in zip(self.directions, self.low, self.scale, strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query, k: int = 10, orderings: int = ORDERINGS, window: float = WINDOW, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest found; is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    fine = every.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return none
    sizes, counts = np.unique([len(x) for x in sample], return_counts=True)
    dim = int(sizes[counts.argmax()])
    curves = spark.sparkContext.broadcast(Curves(np.array([x for x in sample if len(x) == dim]), orderings, DIMENSIONS, BITS, SEED))
    fine = fine.filter(F.size("v") == dim)
    asks = is_query(F.col("vec_id"))

    # a point for each distinct vector, with the least vec_ids; Spark keeps k + 1 in each task before it deals them out
    first = Window.partitionBy("v").orderBy("vec_id")
    few = fine.withColumn("at", F.dense_rank().over(first)).filter(F.col("at") <= k + 1).distinct()
    asked = fine.filter(asks).select("v").distinct().withColumn("asked", F.lit(True))
    points = few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))  # k + 1 ids at most
    points = points.join(asked.withColumnRenamed("v", "av"), F.col("v") == F.col("av"), "left").select(F.col("ids")[0].alias("point"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "v")
    points = written(points, "points")
    total = points.count()
    side = max(WINDOW_LEAST, int(total * window))

    small_batches(spark)

    def order(batches):
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            for i, key in enumerate(curves.value.keys(m)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), i, np.int32)), pa.array(key.astype(np.int64)), batch.column("point"), batch.column("asked"), batch.column("v")], names=["ordering", "key", "point", "asked", "v"])

    keyed = points.select("point", "asked", "v").mapInArrow(order, "ordering int, key long, point long, asked boolean, v array<double>").withColumn("one", F.lit(1).cast("long"))
    placed = positions(keyed, [F.col("ordering"), F.col("key"), F.col("point")], {"place": "one"}, ["ordering"], name="curves")
    own = F.floor(F.col("place") / BLOCK)
    # queries meet the blocks that their windows touch; those of a wide stretch of places go together, so that groups stay bounded
    stretch = F.floor(F.col("place") / (BLOCK * 100))
    reach = lambda x: F.floor(x / BLOCK)
    queries = placed.filter("asked").select("ordering", F.explode(F.sequence(reach(F.greatest(F.lit(0), F.col("place") - side)), reach(F.least(F.lit(total - 1), F.col("place") + side)))).alias("block"), stretch.alias("stretch"), F.lit(True).alias("query"), "place", "point", "v")
    wide = lambda x: F.floor(x / (BLOCK * 100))
    targets = placed.withColumn("block", own).select("ordering", "block", F.explode(F.sequence(wide(F.greatest(F.lit(0), F.col("block") * BLOCK - side)), wide(F.least(F.lit(total - 1), F.col("block") * BLOCK + (BLOCK + side))))).alias("stretch"), F.lit(False).alias("query"), "place", "point", "v")

    def compare(t: pa.Table) -> pa.Table:
        q = np.asarray(t.column("query").to_pylist(), bool)
        place, point = t.column("place").to_numpy(), t.column("point").to_numpy()
        m = _matrix(t.column("v").combine_chunks(), dim)
        a, b = np.flatnonzero(q), np.flatnonzero(~q)
        out = [[], [], []]
        norms = (m[b] ** 2).sum(1)
        for i in range(0, len(a) if len(b) else 0, 256):
            some = a[i : i + 256]
            d = norms[None] - 2 * (m[some] @ m[b].T) + (m[some] ** 2).sum(1)[:, None]
            d[np.abs(place[some][:, None] - place[b][None]) > side] = np.inf
            n = min(k + 1, len(b))
            limit = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(limit), limit, 0)))
            rows, columns = np.nonzero((d <= limit + slack) & np.isfinite(d))
            exact = np.sqrt(((m[some[rows]] - m[b[columns]]) ** 2).sum(1))
            order_ = np.lexsort((point[b[columns]], exact, rows))
            rows, columns, exact = rows[order_], columns[order_], exact[order_]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            best = nth <= k
            out[0].append(point[some[rows[best]]])
            out[1].append(point[b[columns[best]]])
            out[2].append(exact[best])
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query": pa.array(joined[0].astype(np.int64)), "point": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2].astype(np.float64))})

    found = targets.unionByName(queries).groupBy("ordering", "block", "stretch").applyInArrow(compare, "query long, point long, score double")
    merged = found.groupBy("query", "point").agg(F.min("score").alias("score"))
    best = merged.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))).filter(F.col("nth") <= k + 1)
    ids = points.select(F.col("point").alias("p"), "ids")
    hits = best.join(ids, best.point == ids.p).select("query", "score", F.explode("ids").alias("vec_id"))
    near = hits.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, 2 * k + 2).alias("near"))
    # each row that asks: its vector's list without itself
    asking = fine.filter(asks).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).distinct()
    of_point = points.filter("asked").select("point", F.col("v").alias("pv"))
    rows = asking.join(of_point, asking.qv == of_point.pv).select("query_id", "point")
    rows = rows.join(near, rows.point == near["query"])
    mine = F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(mine).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
