"""Vector code compression (operator 12): product codes by Lloyd's rounds that keep every part in a heap.

Vectors become integers and are cut into PARTS equal parts. Each position has a codebook, from the vectors of the least ids;
a round assigns every part to its nearest entry and moves the entries to the floors of their parts' means.

Vectors lie in blocks, one row each. For each position and entry a block holds a heap of the parts assigned to it, keyed by
the lower bound of their distance to all other entries less the upper bound to their own. When entries move, a part of entry
e loses at most the drift of e and the largest drift of another entry; the sum of these over the rounds is e's cumulative
drift, and the key of a part that enters later is raised by the sum so far. So a round pops from a heap only while its least
key is not above the cumulative drift; what it pops is compared with all entries in integers, and pushed where it belongs.
All others stay where they are for sure. Keys are rounded down, so that neither they nor a tie can hide a change.

Only codebooks (ENTRIES entries of one vector's length) and their sums pass through the driver. A block's row carries its
sums for the next round; the heaps are written with it, in their own order, and go on from there in the next one.

Defined results: vectors that are null, or hold null or non-finite components, take no part; nor do those whose length is
no multiple of PARTS or not that of the least id's vector, or with a component beyond LARGEST / SCALE, whose squares a long
could not hold. A null vec_id comes last in order; equal ids go by their vectors' components; repeated rows are vectors of
their own. With fewer vectors than ENTRIES each codebook has as many entries as there are. A null label is a label. An empty
table gives no rows; further columns do not matter.
"""

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, small_batches, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 24
#: Integers in a block: 4096 vectors of 64.
BLOCK_VALUES = 1 << 18
#: Rounding of bounds, relative to them.
MARGIN = 1e-9
#: Rows of a label are dealt over so many keys where they meet its sum.
SALTS = 32

BLOCKS = "ids array<bigint>, labels array<bigint>, data binary, assigned binary, sizes binary, keys binary, members binary, sums array<bigint>"
RESULT = "vec_id bigint, label bigint, code string, error bigint"
_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("data", "assigned", "sizes", "keys", "members")], ("sums", pa.list_(pa.int64()))])
_RESULT = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def nearest_two(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x the nearest entry (the lower one among equals), its squared distance and that of the next, infinite without one."""
    far = ((x[:, None, :] - entries[None]) ** 2).sum(-1)
    best = far.argmin(1)
    at = np.arange(len(x))
    first = far[at, best]
    if len(entries) == 1:
        return best, first, np.full(len(x), np.inf)
    far[at, best] = np.iinfo(np.int64).max
    return best, first, far.min(1).astype(float)


def slack_keys(first: np.ndarray, second: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Keys of parts that enter a heap whose cumulative drift is given, rounded down."""
    own, other = np.sqrt(first.astype(float)), np.sqrt(second)
    key = other - own + drift
    with np.errstate(invalid="ignore"):
        key = np.where(np.isinf(other), np.inf, key - MARGIN * (own + other + drift + 1))
    return np.nextafter(key.astype(np.float32), np.float32(-np.inf))


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much nearer, at most, the entries' moves can bring another entry to a part than its own; by position and entry."""
    moved = np.sqrt(((after - before) ** 2).sum(-1).astype(float))
    if moved.shape[1] == 1:
        return moved * (1 + MARGIN)
    two = np.sort(moved, axis=1)[:, -2:]
    other = np.where(moved == two[:, 1:], np.where(two[:, :1] == two[:, 1:], two[:, 1:], two[:, :1]), two[:, 1:])
    return (moved + other) * (1 + MARGIN)


class Block:
    """Vectors of a block as integers (part position, vector, place in the part), their entries, and the heaps."""

    def __init__(self, data: np.ndarray, entries: int):
        self.data, self.count = data, data.shape[1]
        self.assigned = np.zeros((PARTS, self.count), np.uint8)
        self.heaps: list[list[list]] = [[[] for _ in range(entries)] for _ in range(PARTS)]

    def fill(self, books: np.ndarray) -> None:
        """The first round: every part is compared with all entries."""
        for p in range(PARTS):
            best, first, second = nearest_two(self.data[p], books[p])
            self.assigned[p] = best
            for member, (entry, key) in enumerate(zip(best.tolist(), slack_keys(first, second, np.zeros(1)).tolist(), strict=True)):
                self.heaps[p][entry].append((key, member))
            for heap in self.heaps[p]:
                heapify(heap)

    def settle(self, books: np.ndarray, drift: np.ndarray) -> int:
        """A later round: pops the parts whose bounds the cumulative drift has reached. Returns their number."""
        popped = 0
        for p in range(PARTS):
            out = []
            for heap, limit in zip(self.heaps[p], drift[p].tolist(), strict=True):
                while heap and heap[0][0] <= limit:
                    out.append(heappop(heap)[1])
            if out:
                best, first, second = nearest_two(self.data[p][out], books[p])
                self.assigned[p][out] = best
                for member, entry, key in zip(out, best.tolist(), slack_keys(first, second, drift[p][best]).tolist(), strict=True):
                    heappush(self.heaps[p][entry], (key, member))
            popped += len(out)
        return popped

    def sums(self) -> np.ndarray:
        """Number and sums of the parts of each position and entry."""
        entries = len(self.heaps[0])
        out = np.zeros((PARTS, entries, 1 + self.data.shape[2]), np.int64)
        for p in range(PARTS):
            out[p, :, 0] = np.bincount(self.assigned[p], minlength=entries)
            np.add.at(out[p, :, 1:], self.assigned[p], self.data[p])
        return out

    def row(self) -> dict:
        flat = [x for heaps in self.heaps for heap in heaps for x in heap]
        narrow = np.int16 if not self.data.size or np.abs(self.data).max() < 1 << 15 else np.int32
        return {
            "data": self.data.astype(f"<{np.dtype(narrow).str[1:]}").tobytes(), "assigned": self.assigned.tobytes(),
            "sizes": np.array([len(heap) for heaps in self.heaps for heap in heaps], "<i4").tobytes(),
            "keys": np.array([x for x, _ in flat], "<f4").tobytes(), "members": np.array([x for _, x in flat], "<i4").tobytes(), "sums": self.sums().reshape(-1).tolist(),
        }

    @classmethod
    def read(cls, r: dict, width: int) -> "Block":
        n = len(r["ids"])
        kind = "<i2" if len(r["data"]) == 2 * n * PARTS * width else "<i4"
        sizes = np.frombuffer(r["sizes"], "<i4")
        out = cls(np.frombuffer(r["data"], kind).astype(np.int64).reshape(PARTS, n, width), len(sizes) // PARTS)
        out.assigned = np.frombuffer(r["assigned"], np.uint8).reshape(PARTS, n).copy()
        flat = list(zip(np.frombuffer(r["keys"], "<f4").tolist(), np.frombuffer(r["members"], "<i4").tolist(), strict=True))
        ends = np.cumsum(sizes).tolist()
        lists = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]  # heaps still: as they were written
        each = len(lists) // PARTS
        out.heaps = [lists[p * each : (p + 1) * each] for p in range(PARTS)]
        return out


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return np.floor(x * SCALE).astype(np.int64).reshape(len(x), PARTS, dim // PARTS).transpose(1, 0, 2)


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floors of means; entries without parts stay."""
    shape = (*books.shape[:2], books.shape[2] + 1)
    sums = np.zeros(int(np.prod(shape)), np.int64)
    for r in blocks.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # as many rows as a codebook has numbers
        sums[r["at"]] = r["x"]
    sums = sums.reshape(shape)
    return np.where(sums[:, :, :1] > 0, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, block_values: int = BLOCK_VALUES, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(F.least(F.abs(x), F.lit(2.0 * LARGEST)) * SCALE) < LARGEST)
    fine = every.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0)).filter(F.forall("v", inside))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = fine.orderBy(*order).select("v").first()
    if first is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = len(first.v)
    width = dim // PARTS
    fine = fine.filter(F.size("v") == dim)
    seeds = fine.orderBy(*order).limit(entries).select("v").toArrow().column("v").combine_chunks()
    books, drift = _integers(seeds, dim), np.zeros((PARTS, len(seeds)))
    most = max(1, block_values // dim)
    small_batches(spark)

    def form(batches):
        held: list[pa.RecordBatch] = []

        def block(rows: pa.RecordBatch) -> dict:
            out = Block(_integers(rows.column("v"), dim), len(books[0]))
            out.fill(books)
            return {"ids": rows.column("vec_id").to_pylist(), "labels": rows.column("label").to_pylist(), **out.row()}

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= most:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_pylist([block(rows.slice(0, most))], _BLOCKS)
                held = [rows.slice(most)]
        if sum(b.num_rows for b in held):
            yield pa.RecordBatch.from_pylist([block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])], _BLOCKS)

    def later(books: np.ndarray, drift: np.ndarray):
        def settle(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    block = Block.read(r, width)
                    block.settle(books, drift)
                    yield pa.RecordBatch.from_pylist([r | block.row()], _BLOCKS)

        return settle

    blocks = written(fine.mapInArrow(form, BLOCKS), "codes")
    for step in range(rounds):
        new = _moved(blocks, books)
        drift = drift + drifts(books, new)
        books = new
        if step + 1 < rounds:
            more = written(blocks.mapInArrow(later(books, drift), BLOCKS), "codes")
            dropped(blocks)
            blocks = more

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block = Block.read(r, width)
                block.settle(books, drift)
                error = sum(((block.data[p] - books[p][block.assigned[p]]) ** 2).sum(-1) for p in range(PARTS))
                raw, n = block.assigned.T.tobytes().hex(), 2 * PARTS
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["labels"], pa.int64()), pa.array([raw[i * n : (i + 1) * n] for i in range(block.count)], pa.string()), pa.array(error, pa.int64())], schema=_RESULT)

    told = written(blocks.select("ids", "labels", "data", "assigned", "sizes", "keys", "members").mapInArrow(finish, RESULT), "coded")
    dropped(blocks)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = told.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = told.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, salted.label.eqNullSafe(sums.of) & (salted.salt == sums.of_salt))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
