"""N-gram Jaccard join (operator 5): near-duplicate documents by PartEnum signatures.

A document's set holds its distinct word shingles. Sets are compared within bands of sizes: two sets of similarity J have
sizes in the same or in adjacent bands, and differ in at most k shingles, k following from J and the band's largest size.
For each band, a hash deals the domain of shingles to n > k partitions. Two sets that differ in at most k shingles agree on
at least n - k whole partitions: each subset of one partition gives a signature, the hash of what the set has there, and
similar sets share one.

Partitions in which a set has none or few shingles (Bands.light) say little, and sets that have nothing in common share them. They
give no signature. n leaves room for them: n - k - 1 may be light. If all agreeing partitions of a pair are light, then both
of its sets have more light ones than that; such sets give signatures by a second dealing too, and so on; the last
dealing takes all partitions. No pair is lost.

Equal sets are one vertex from the start. Of the sets that share a signature, all are compared exactly with one of them;
those that have not joined the others' component go on to another pivot, and what is still apart after that is compared
within bands of sizes, in chunks of bounded bytes. Sets too many of whose shingles no other candidate has are left out
before. So a group of copies costs about its size, and components are exact. Pairs meet as sketches first, of some two
bits for each shingle: a bit that only one of two sets has is a shingle that the other lacks. Only pairs that have few
such bits meet as sets of shingles: sets that share a signature and are not similar may make more pairs than similar ones. A signature that many sets share meets its
pivot by a broadcast of such signatures' pivots, of which there are HOT_SIGNS at most, so that no task gets all its members.

Defined results: a null text or one without words has an empty set and links with nothing. Fewer words than a shingle make
one shingle of all. Equal texts link. Rows of equal doc_id are judged by their texts. An empty table gives no rows; further
columns do not matter. Shingles are told apart within a comparison by 64-bit hashes, sets by 128 bits, the second half
from hashes of their own; a vertex is the first half, or a hash of both where sets of different second halves have the same.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, RANGE_HASHES, block_of, column, cut, deal, distinct, flags, member, packed, text_bytes, text_key, twice, unflagged, unpacked
from .components import components
from .storage import batch_rows, dropped, small_batches, written
from .textkernel import LOWER, Texts, mix, steps, windows

DEALINGS = 6
PIVOT_ROUNDS = 2
#: The first round looks at one signature in so many.
FIRST_OF = 8
#: Bytes of sketches, and members, in a chunk of what is left apart.
CHUNK_BYTES = 1_000_000
CHUNK_ROWS = 150
#: Bits of exchanged signatures beyond those that number them all.
SPARE_BITS = 14
#: A signature is hot if one in so many members has it; so there are no more of them.
HOT_SIGNS = 500
#: Kinds of rows that a block gets: the sets chosen to stand for a vertex, and answers about signatures and shingles.
CHOSEN, SIGNS, CELLS = 0, 1, 2
_K1, _K2, _K3 = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


class Bands:
    """Bands of set sizes for a similarity of at least percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]
        # shingles in a partition, at least, of a band's smallest sets; where they are few, single ones must count
        crowd = (percent / 100) ** 2 * (100 + percent) / (2 * max(1, 100 - percent))
        #: A partition with fewer shingles is light.
        self.light = 2 if crowd >= 4 else 1

    def until(self, size: int) -> np.ndarray:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return np.array(self.lows)

    def differ(self, band: np.ndarray) -> np.ndarray:
        """Most shingles in which similar sets differ, if neither is over the band's largest size."""
        top = self.until(0)[0] if not len(band) else np.array([low * 100 // self.percent for low in self.lows])[band]
        part = Fraction(100 - self.percent, 100 + self.percent)
        return 2 * top * part.numerator // part.denominator


def shingle_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, by text and then by hash: text, hash, and a second, independent hash of each."""
    doc = t.words()[2]
    n = np.bincount(doc, minlength=t.count)
    short = np.flatnonzero((n > 0) & (n < width))
    both = []
    for which in (0, 1):
        hashes = t.word_hashes(which, LOWER)
        at, keys = windows(hashes, doc, width)
        places = [at]
        if len(short):
            first, size = np.searchsorted(doc, short), n[short]
            for k in range(1, width):
                begin = first[size == k]
                whole = np.zeros(len(begin), np.uint64)
                for j in range(k):
                    whole = mix(mix(whole * _K1 + np.uint64(k)) ^ hashes[begin + j])
                places.append(begin)
                keys = np.concatenate([keys, whole])
        both.append(keys)
    keys, more = both
    of = doc[np.concatenate(places)]
    order = np.lexsort((keys, of))
    of, keys, more = of[order], keys[order], more[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    return of[new], keys[new], more[new]


def set_digests(of: np.ndarray, keys: np.ndarray, more: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each text's set."""
    n = np.bincount(of, minlength=count)
    out = []
    for values in (keys, more):
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, of, mix(values ^ _K2))
        out.append(mix(sums + n.astype(np.uint64) * _K3).view(np.int64))
    return n, out[0], out[1]


def signatures(of: np.ndarray, keys: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Owner (an index of size) and signature, for the band of each set and the next one."""
    n = len(size)
    if not n or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lows = bands.until(int(size.max()) * 2 + 2)
    own = np.searchsorted(lows, size, "right") - 1
    owners, found = [], []
    for band in (own, own + 1):
        differ = bands.differ(band)
        spare = -(-(differ + 1) * 15 // 100) + np.where(differ < 8, 1, 2)
        parts = np.where((differ > 0) & (size > 0), differ + 1 + spare, 0)  # sets that may not differ are one vertex already
        active = np.flatnonzero(parts > 0)
        for dealing in range(DEALINGS):
            salt = mix(np.full(1, dealing + 1, np.uint64))
            if not len(active):
                break
            here = np.zeros(n, bool)
            here[active] = True
            mine = here[of]
            k, o = keys[mine], of[mine]
            base = np.zeros(n + 1, np.int64)
            base[1:] = np.cumsum(np.where(here, parts, 0))
            seed = mix(band.astype(np.uint64) * _K1 + salt)
            part = ((mix(k + seed[o]) >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)
            slot = base[o] + part.astype(np.int64)
            held = np.bincount(slot, minlength=base[-1])
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, slot, mix(k ^ _K3))
            owner = np.repeat(np.arange(n), np.diff(base))
            number = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
            sign = mix(sums + mix(seed[owner] + number))
            heavy = held >= bands.light
            if dealing == DEALINGS - 1:
                heavy[:] = True
            owners.append(owner[heavy])
            found.append(sign[heavy])
            light = np.bincount(owner[~heavy], minlength=n)
            active = np.flatnonzero(here & (light > spare))
    return np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.uint64)])


_SENT = {"slice": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "marks": pa.binary()}
SENT = "slice int, block int, keys binary, marks binary"
FOUND = "block int, vertex long, n long, signs array<long>, shingles binary"
SETS = "vertex long, n long, signs array<long>, shingles binary, common long, sketch binary"


def sketches(keys: np.ndarray, n: np.ndarray, percent: int) -> list[bytes]:
    """A set's shingles as bits, told by their last bits: a power of two of them, 64 at least and over 160 / percent for each shingle; keys: of sets of n each, one after the other."""
    size = np.array([1 << max(6, (int(k) * 160 // percent).bit_length()) for k in n], np.int64)
    base = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), n)
    held = np.zeros(base[-1], bool)
    held[base[owner] + (keys & (size[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    raw = np.packbits(held).tobytes()
    return [raw[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def most_common(left: list[bytes], right: list[bytes], n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """For each pair of sets, by their sketches and sizes, a number that their intersection does not exceed.

    Each bit that only one of them has is a shingle at least that the other lacks. Of sketches of two lengths the longer
    one is folded: the bits of its halves are the sketch of half the length.
    """
    out = np.minimum(n_left, n_right)
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    for lengths in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == lengths).all(axis=1))
        one, two = (np.frombuffer(b"".join([of[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1) for of in (left, right))
        while one.shape[1] != two.shape[1]:
            half = max(one.shape[1], two.shape[1]) // 2
            one, two = (x[:, :half] | x[:, half:] if x.shape[1] > half else x for x in (one, two))
        lost = [np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((one, two), (two, one))]
        out[at] = np.minimum(n_left[at] - lost[0], n_right[at] - lost[1])
    return out


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.table({k: pa.array([r[i] for r in rows], _SENT[k]) for i, k in enumerate(_SENT)})


def document_sets(docs: DataFrame, width: int, extra: list[str] | None = None) -> DataFrame:
    """doc_id, text_key, n_shingles, and h and h2 (hashes of the set; null for an empty one) of each row; extra: columns of docs to pass on, as _x0, _x1 and so on."""
    small_batches(docs.sparkSession)
    extra = extra or []

    def sets(batches):
        for batch in batches:
            for t in steps(batch.column("text")):
                n, one, two = set_digests(*shingle_sets(t, width), t.count)
                own = batch.slice(t.rows.start, t.count)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_key"), pa.array(n.astype(np.int64)), pa.array(one, mask=n == 0), pa.array(two, mask=n == 0), *[own.column(x) for x in names]], names=["doc_id", "text_key", "n_shingles", "h", "h2", *names])

    names = [f"_x{i}" for i in range(len(extra))]
    schema = "doc_id long, text_key long, n_shingles long, h long, h2 long" + "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for x, c in zip(names, extra, strict=True))
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text", *[F.col(c).alias(x) for x, c in zip(names, extra, strict=True)])
    return taken.mapInArrow(sets, schema)


def vertices(rows: DataFrame) -> DataFrame:
    """(h, h2, vertex, doc_id, text_key) of each distinct set in rows, with the least doc_id that has it, and of its texts that of the least key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    firsts = written(rows.filter("h is not null").groupBy("h", "h2").agg(first).select("h", "h2", "first.doc_id", "first.text_key"), "jaccard-sets")
    shared = firsts.groupBy(F.col("h").alias("of")).agg(F.count("*").alias("k")).filter("k > 1")  # of 10**10 sets, one or two
    joined = firsts.join(shared, firsts.h == shared.of, "left")
    return joined.select("h", "h2", F.when(F.col("k").isNull(), F.col("h")).otherwise(F.xxhash64("h", "h2")).alias("vertex"), "doc_id", "text_key")


def candidate_sets(docs: DataFrame, firsts: DataFrame, width: int, percent: int) -> DataFrame:
    """SETS of each vertex that shares a signature with another one and may be similar to one, written.

    signs: the signatures that others share; common: the shingles that other candidates have too, or a few more. A similar
    set holds percent / 100 of a set's shingles at least, and no shingle that only this one has. Copies with changes of
    their own, too many to be similar, and documents that share a passage, share signatures with each other; counting the
    candidates' shingles in a sketch, which may overestimate, lets them go before they are compared. Most go so before any
    shingles are written; what these had in common with the rest is then counted no more. firsts: as vertices().
    """
    total = text_bytes(docs)
    slices = max(1, -(-total // (10 * RANGE_HASHES)))
    dealt = deal(docs, total)
    chosen = firsts.select(F.lit(CHOSEN).alias("kind"), F.lit(-1).alias("slice"), block_of(F.col("doc_id"), F.col("text_key"), total, BLOCK_BYTES).alias("block"), F.col("doc_id"), F.col("h"), F.col("h2"), F.col("vertex"), F.lit(None).cast("binary").alias("keys"))

    def own_sets(left: pa.Table, right: pa.Table):
        """For each step: sets of the block's chosen rows, as owners, shingles, sizes and vertices."""
        rows = {x[:3]: x[3] for x in zip(*[column(right, x) for x in ("doc_id", "h", "h2", "vertex", "kind")], strict=True) if x[4] == CHOSEN}
        doc_ids, done = column(left, "doc_id"), 0
        for t in steps(left.column("text")):
            of, keys, more = shingle_sets(t, width)
            n, one, two = set_digests(of, keys, more, t.count)
            mine, vertex = np.zeros(t.count, bool), np.zeros(t.count, np.int64)
            for i, own in enumerate(zip(doc_ids[done : done + t.count], one.tolist(), two.tolist(), strict=True)):
                if own in rows:
                    vertex[i] = rows.pop(own)  # a repeated row is the same vertex
                    mine[i] = True
            done += t.count
            new = np.cumsum(mine) - 1
            some = mine[of]
            if mine.any():
                yield new[of[some]], keys[some], n[mine], vertex[mine]

    # bits of a signature that blocks exchange: so many that few sets share one by chance, which costs their rows and no more
    sign_bits = min(64, (total // 6).bit_length() + SPARE_BITS)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sent([])
        bands = Bands(percent)
        found = [signatures(of, keys, n, bands)[1] for of, keys, n, _ in own_sets(left, right)]
        if not found:
            return _sent([])
        keys = np.sort(np.concatenate(found)) >> np.uint64(64 - sign_bits)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        marks, keys = np.diff(np.append(at, len(keys))) > 1, keys[at]
        places, block = cut(keys, slices, sign_bits), column(left, "block")[0]
        return _sent([(i, block, packed(keys[a:b]), flags(marks[a:b])) for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)) if b > a])

    def told_of(right: pa.Table, kind: int) -> np.ndarray:
        """What a block has been told of its hashes, sorted."""
        answers = sorted((s, x) for k, s, x in zip(*[column(right, c) for c in ("kind", "slice", "keys")], strict=True) if k == kind)
        return np.concatenate([np.zeros(0, np.uint64), *[unpacked(x) for _, x in answers]])

    def sharing(left: pa.Table, right: pa.Table):
        """The chosen sets of each step, and by owner the signatures that others share."""
        shared, bands = told_of(right, SIGNS), Bands(percent)
        for of, keys, n, vertex in own_sets(left, right) if left.num_rows and len(shared) else ():
            owner, sign = signatures(of, keys, n, bands)
            hit = member(shared, sign >> np.uint64(64 - sign_bits))
            yield of, keys, n, vertex, owner[hit], sign[hit]

    bits = min(60, max(16, (total // 6).bit_length() + 5))

    def sketched(keys: np.ndarray, block: int) -> pa.Table:
        cells, marks = distinct(keys >> np.uint64(64 - bits))
        places = cut(cells, slices, bits)
        return _sent([(i, block, packed(cells[a:b]), flags(marks[a:b])) for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)) if b > a])

    def first_sketch(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for of, keys, n, _, owner, _ in sharing(left, right):
            some = np.zeros(len(n), bool)
            some[owner] = True
            found.append(keys[some[of]])
        return sketched(np.concatenate(found), column(left, "block")[0]) if found else _sent([])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """The chosen sets that share a signature, with their shared signatures, if others that do have enough of their shingles."""
        out, cells = [], told_of(right, CELLS)
        block = column(left, "block")[0] if left.num_rows else None
        for of, keys, n, vertex, owner, sign in sharing(left, right):
            common = np.bincount(of[member(cells, keys >> np.uint64(64 - bits))], minlength=len(n))
            some = 100 * common >= percent * n
            owner, sign = owner[some[owner]], sign[some[owner]]
            order = np.argsort(owner, kind="stable")
            owner, sign = owner[order], sign[order]
            ends, signs = np.searchsorted(of, np.arange(len(n) + 1)), np.searchsorted(owner, np.arange(len(n) + 1))
            out += [(block, int(vertex[i]), int(n[i]), np.unique(sign[signs[i] : signs[i + 1]]).view(np.int64), keys[ends[i] : ends[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(signs)).tolist()]
        return _sets(out, FOUND)

    def keys_of(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(column(t, "shingles")), np.uint64)

    def sketch(t: pa.Table) -> pa.Table:
        return sketched(keys_of(t), column(t, "block")[0])

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sets([], SETS)
        answers = sorted(zip(column(right, "slice"), column(right, "keys"), strict=True))
        n = left.column("n").to_numpy()
        owner, keys = np.repeat(np.arange(len(n)), n), keys_of(left)
        common = np.bincount(owner[member(np.concatenate([unpacked(k) for _, k in answers]), keys >> np.uint64(64 - bits))], minlength=len(n))
        whole = left.drop_columns(["block"]).append_column("common", pa.array(common, pa.int64())).append_column("sketch", pa.array(sketches(keys, n, percent), pa.binary()))
        return whole.filter(pa.array(100 * common >= percent * n))

    none = F.lit(None).cast("long")
    full = lambda df, kind: df.select(F.lit(kind).alias("kind"), "slice", "block", *[none.alias(x) for x in ("doc_id", "h", "h2", "vertex")], "keys")
    pairs = lambda told: dealt.groupBy("block").cogroup(told.groupBy("block"))
    met = lambda df: df.groupBy("slice").applyInArrow(_meet, SENT)
    # texts are dealt anew after what blocks exchange is let go, and let go themselves before what is found is dealt; sets
    # that share a signature are many more than those that may be similar, and are made anew in place of being kept
    told = written(met(pairs(chosen).applyInArrow(send, SENT)), "jaccard-shared")
    asked = chosen.unionByName(full(told, SIGNS))
    cells = written(met(pairs(asked).applyInArrow(first_sketch, SENT)), "jaccard-cells")
    found = written(pairs(asked.unionByName(full(cells, CELLS))).applyInArrow(candidates, FOUND), "jaccard-candidates")
    dropped(told, cells)
    by_block = found.groupBy("block")
    sets = written(by_block.cogroup(met(by_block.applyInArrow(sketch, SENT)).groupBy("block")).applyInArrow(emit, SETS), "jaccard-sets")
    dropped(found)
    return sets


def _sets(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.table({k: pa.array([r[i] for r in rows], types[kind]) for i, (k, kind) in enumerate(c.split() for c in schema.split(", "))})


def _meet(t: pa.Table) -> pa.Table:
    """To each block, those of the hashes that it sent which occur twice or more in all."""
    blocks, part = column(t, "block"), column(t, "slice")[0]
    keys = [unpacked(x) for x in column(t, "keys")]
    marks = [unflagged(x, len(k)) for x, k in zip(column(t, "marks"), keys, strict=True)]
    shared = twice(np.concatenate(keys), np.concatenate(marks))
    own = [k[member(shared, k)] for k in keys]
    return _sent([(part, b, packed(k), None) for b, k in zip(blocks, own, strict=True) if len(k)])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar, by their exact intersection."""

    def judge(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                both = int(member(a, b).sum())
                good[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return _with_both(pairs, sets, "shingles").select("a", "b", "left", "right").mapInArrow(judge, "a long, b long")


def not_apart(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets may be similar by their sketches: all that are, and few others."""

    def judge(batches):
        for batch in batches:
            n_left, n_right = (batch.column(x).to_numpy() for x in ("n_left", "n_right"))
            most = most_common(*[batch.column(x).to_pylist() for x in ("left", "right")], n_left, n_right)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array((100 + percent) * most >= percent * (n_left + n_right))) for x in ("a", "b")], names=["a", "b"])

    return _with_both(pairs, sets, "sketch").select("a", "b", "left", "right", "n_left", "n_right").mapInArrow(judge, "a long, b long")


def _with_both(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """pairs (a, b) with a column of both sets, as left and right, and their sizes."""
    one = sets.select(F.col("vertex").alias("va"), F.col("n").alias("n_left"), F.col(what).alias("left"))
    two = sets.select(F.col("vertex").alias("vb"), F.col("n").alias("n_right"), F.col(what).alias("right"))
    return pairs.join(two, pairs.b == two.vb).join(one, F.col("a") == one.va)


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links reach) of each row; links are pairs of similarity percent / 100 or more."""
    return jaccard_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, width: int = 5, percent: int = 80, extra: list[str] | None = None) -> DataFrame:
    """jaccard_join's rows with component, which is told by vertices and so for rows without a doc_id too (null for an empty set), and columns of docs."""
    extra = extra or []
    rows = written(document_sets(docs, width, extra), "jaccard-rows")
    firsts = written(vertices(rows), "jaccard-firsts")
    sets = candidate_sets(docs, firsts, width, percent)
    members = sets.select(F.explode("signs").alias("sign"), "vertex", F.col("n").cast("int").alias("n"), F.col("common").cast("int").alias("common"))
    links, made = link_members(members, sets, percent)
    labels = components(links)
    dropped(sets, *made)
    joined = firsts.join(labels, firsts.vertex == labels.v, "left").select("h", "h2", "doc_id", F.coalesce("comp", "vertex").alias("comp"))
    least = joined.groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("component_id"))
    of_set = joined.join(least, joined.comp == least.c).select(F.col("h").alias("of"), F.col("h2").alias("of2"), "component_id", F.col("comp").alias("component"))
    found = rows.join(of_set, (rows.h == of_set.of) & (rows.h2 == of_set.of2), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component", *[F.col(f"_x{i}").alias(x) for i, x in enumerate(extra)])


def _hot(members: DataFrame) -> list[int]:
    """Signatures that so many of members have that one task should not get them all: HOT_SIGNS of them at most."""
    total = members.count()
    held = members.groupBy("sign").agg(F.count("*").alias("held"))
    return [r.sign for r in held.filter(F.col("held") * HOT_SIGNS > total).select("sign").collect()]


def _with_sign(members: DataFrame, told: DataFrame, hot: list[int], on=None) -> DataFrame:
    """members joined with what is told of their signature: told has a row for each (s); hot: as _hot()."""
    same = F.col("sign") == F.col("s")
    same = same if on is None else same & on
    if not hot:
        return members.join(told, same)
    crowded = members.filter(F.col("sign").isin(hot)).join(F.broadcast(told.filter(F.col("s").isin(hot))), same)
    return crowded.unionByName(members.filter(~F.col("sign").isin(hot)).join(told.filter(~F.col("s").isin(hot)), same))


def link_members(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that join all similar sets among those that share a signature, and the tables that hold them; members: (sign, vertex, n, common).

    An intersection holds no more than what either set has in common with others. The first pivot of a signature is the set
    with the fewest shingles of its own: of changed copies, that nearest to what they are copies of.
    """
    own = ["vertex", "n", "common", "comp"]
    fits = (100 + percent) * F.least("common", "p.common") >= percent * (F.col("n") + F.col("p.n"))
    links = tested = labels = None
    left, made = members, []
    spark = members.sparkSession
    # the first round needs few signatures to join most copies; all that are left have their turn after it
    groups = members.filter(F.pmod("sign", F.lit(FIRST_OF)) == 0).withColumn("comp", F.col("vertex"))
    for turn in range(PIVOT_ROUNDS):
        first = F.col("n") - F.col("common") if turn == 0 else F.xxhash64("vertex", F.lit(turn))
        pivots = groups.groupBy(F.col("sign").alias("s")).agg(F.min(F.struct(first.alias("turn"), *own)).alias("p"))
        pairs = _with_sign(groups, pivots, _hot(groups), (F.col("comp") != F.col("p.comp")) & fits)
        pairs = pairs.select(F.greatest("vertex", "p.vertex").alias("a"), F.least("vertex", "p.vertex").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(not_apart(pairs, sets, percent), "jaccard-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        with batch_rows(spark, 200):
            more = written(similar(pairs, sets, percent), "jaccard-links")
        made += [pairs, more]
        links = more if links is None else links.unionByName(more)
        labels = components(links)
        named = left.join(labels, left.vertex == labels.v, "left").select("sign", "vertex", "n", "common", F.coalesce("comp", "vertex").alias("comp"))
        # members that could link with a member as small as their signature's least, and signatures of which two components are left
        stats = lambda df: df.groupBy(F.col("sign").alias("s")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).filter("lo <> hi")
        could = _with_sign(named, stats(named).select("s", "least"), _hot(left), (100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("least")))
        could = written(could.select(*named.columns), "jaccard-could")
        groups = written(_with_sign(could, stats(could).select("s"), _hot(could)).select(*named.columns), "jaccard-groups")
        dropped(could)
        made.append(groups)
        if not groups.limit(1).count():
            return links, made
        left = groups.drop("comp")  # components only grow: what has been dropped stays so
    pairs = written(pairs_apart(groups, sets, percent), "jaccard-pairs")
    with batch_rows(spark, 200):
        apart = written(similar(pairs, sets, percent), "jaccard-links")
    return links.unionByName(apart), [*made, pairs, apart]


def pairs_apart(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components that share a signature, directly or by way of others, and may be similar.

    Such members make clusters. Similar sets of a cluster are in one band of sizes or in adjacent ones; a band's members are
    dealt to chunks of CHUNK_BYTES and CHUNK_ROWS at most or about, and two chunks of one or of adjacent bands are compared within one task, by their
    sketches, since each member is dealt to as many tasks as there are chunks. A task holds two chunks, whatever a cluster's size.
    """
    least = groups.groupBy(F.col("sign").alias("s")).agg(F.min("vertex").alias("b"))
    ties = groups.join(least, F.col("sign") == F.col("s")).select(F.col("vertex").alias("a"), "b").filter("a <> b").distinct()
    labels = components(ties).withColumnRenamed("comp", "cluster")
    lows = F.array(*[F.lit(int(x)) for x in Bands(percent).until(1 << 40)])
    band = F.size(F.filter(lows, lambda low: low <= F.col("n").cast("long")))
    rows = groups.select("vertex", "n", "common", "comp").distinct().join(labels, F.col("vertex") == F.col("v")).withColumn("band", band)
    rows = rows.join(sets.select(F.col("vertex").alias("of"), "sketch"), F.col("vertex") == F.col("of"))
    rows = written(rows.select("vertex", "n", "common", "comp", "cluster", "band", "sketch"), "jaccard-apart")
    sizes = rows.groupBy(F.col("cluster").alias("c"), F.col("band").alias("in_band")).agg(F.greatest(F.ceil(F.sum(F.length("sketch")) / CHUNK_BYTES), F.ceil(F.count("*") / CHUNK_ROWS)).cast("int").alias("chunks"))
    held = lambda shift, name: sizes.select(F.col("c").alias(f"{name}_c"), (F.col("in_band") + shift).alias(f"{name}_band"), F.col("chunks").alias(name))
    for shift, name in ((0, "own"), (-1, "above"), (1, "below")):
        told = held(shift, name)
        rows = rows.join(told, (rows.cluster == told[f"{name}_c"]) & (rows.band == told[f"{name}_band"]), "left").drop(f"{name}_c", f"{name}_band")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("vertex"), F.col("own")).cast("int"))
    upto = lambda name: F.when(F.col(name).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(name) - 1))
    task = lambda lower, i, j, side: F.struct(lower.alias("lower"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    chunk = F.col("chunk")
    tasks = F.concat(
        F.transform(upto("own"), lambda x: task(F.col("band"), F.least(chunk, x), F.greatest(chunk, x), 0)),
        F.transform(upto("above"), lambda x: task(F.col("band"), chunk, x, 1)),
        F.transform(upto("below"), lambda x: task(F.col("band") - 1, x, chunk, 1)),
    )
    rows = rows.withColumn("t", F.explode(tasks)).select("cluster", "t.*", "band", "chunk", "vertex", "n", "common", "comp", "sketch")

    def compare(t: pa.Table) -> pa.Table:
        told = column(t, "sketch")
        vertex, n, common, comp, chunk, band = (t.column(c).to_numpy().astype(np.int64) for c in ("vertex", "n", "common", "comp", "chunk", "band"))
        lower, i, j, side = (column(t, c)[0] for c in ("lower", "i", "j", "side"))
        left, right = np.flatnonzero((chunk == i) & (band == lower)), np.flatnonzero((chunk == j) & (band == lower + side))
        out = []
        for a in left.tolist():
            b = right[comp[right] != comp[a]]
            b = b[vertex[b] > vertex[a]] if not side and i == j else b
            b = b[(100 + percent) * np.minimum(common[b], common[a]) >= percent * (n[b] + n[a])]
            if len(b):
                most = most_common([told[a]] * len(b), [told[k] for k in b.tolist()], np.full(len(b), n[a]), n[b])
                hit = b[(100 + percent) * most >= percent * (n[b] + n[a])]
                out += [(int(vertex[a]), int(v)) for v in vertex[hit]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return rows.groupBy("cluster", "lower", "side", "i", "j").applyInArrow(compare, "a long, b long")
