"""Source divergence audit (operator 11): how far the words of a language's sources lie apart, by integer-dictionary encoding.

1. Each batch of documents counts its terms, and its documents that hold them, by language and source; Spark sums the counts.
2. A language's terms are dealt into chunks by hash. A chunk's terms in enough documents form its dictionary, an array in
   UTF-8 order; a binary search gives each term its id, and a sum over ids the counts of every source. Ids keep the order of
   the terms, so that among equal values the smaller id goes first. A chunk's ids are cut into parts of WIDTH.
3. A part's sources, at most two tiles of them at a time, become dense vectors of smoothed shares. Differences of vectors,
   summed over all parts, are the distance of two sources; differences from the language's own vector tell a source's terms.

The memory of a task is bounded by the rows of a chunk and by WIDTH times the sources of two tiles. Shares are computed in
integers by long division, exact while a group has fewer than 9e15 terms; counts are summed in doubles, exact below 2**53.

Defined results: null text, lang and source are empty strings. A language without kept terms has distances of 0 and no terms.
Repeated rows and equal doc_ids are documents of their own. A text of any length is counted whole, a term of any length is a
term. An empty table gives no rows; further columns do not matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, small_batches, written
from .textkernel import LOWER, Texts, steps

#: A term is kept in a language if so many of its documents hold it.
LEAST_DOCS = 30
#: What every count of a kept term is raised by, and the shares' unit.
SMOOTHING = 5
SCALE_STEPS = 3  # of a factor of 1000 each
#: Terms of a source that are returned.
TERMS = 50
#: Counted (source, term) rows of a chunk, and bytes of their terms, about.
CHUNK_ROWS = 200_000
CHUNK_BYTES = 16_000_000
#: Terms of a part, and sources of a tile.
WIDTH = 4096
TILE = 256
#: Bytes of text that are counted at a time.
STEP = 4_000_000

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

COUNTED = "lang string, source string, term string, docs long, n long"
ENCODED = "lang string, chunk int, part int, width int, source string, total long, ids binary, counts binary, terms array<string>"
FOUND = "kind string, lang string, source string, item string, value long"
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
_ENCODED = pa.schema([("lang", pa.string()), ("chunk", pa.int32()), ("part", pa.int32()), ("width", pa.int32()), ("source", pa.string()), ("total", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("terms", pa.list_(pa.string()))])
_FOUND = pa.schema([(x, pa.string()) for x in ("kind", "lang", "source", "item")] + [("value", pa.int64())])


def terms_of(t: Texts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and code of each term of some texts, and the distinct terms that the codes stand for, in ASCII lower case."""
    inside = LETTER[t.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's first and last byte begin and end a term, whatever stands next to them
    begins, ends = t.offsets[:-1][t.offsets[:-1] < t.offsets[1:]], t.offsets[1:][t.offsets[:-1] < t.offsets[1:]] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    raw = np.ascontiguousarray(LOWER[t.data[inside]])
    each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(raw)])
    found = each.dictionary_encode()
    return t.doc_of(start), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _count(batches):
    """Rows of COUNTED for each batch; those without a term tell that the group occurs."""
    for batch in batches:
        for t in steps(batch.column("text"), STEP):
            cut = batch.slice(t.rows.start, t.count)
            numbers: dict[tuple, int] = {}
            group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(cut.column("lang").to_pylist(), cut.column("source").to_pylist(), strict=True)], np.int64)
            doc, code, terms = terms_of(t)
            width = max(1, len(terms))
            pair, n = np.unique(doc * width + code, return_counts=True)
            key, at = np.unique(group[pair // width] * width + pair % width, return_inverse=True)
            docs, n = np.bincount(at, minlength=len(key)), np.bincount(at, n, len(key)).astype(np.int64)
            of, none = np.append(key // width, np.arange(len(numbers))), np.zeros(len(numbers), np.int64)
            names = [pa.array(list(x), pa.string()) for x in zip(*numbers, strict=True)]
            words = pa.concat_arrays([terms.take(pa.array(key % width)).cast(pa.binary()).cast(pa.string()), pa.nulls(len(numbers), pa.string())])
            yield pa.RecordBatch.from_arrays([x.take(pa.array(of)) for x in names] + [words, pa.array(np.append(docs, none)), pa.array(np.append(n, none))], schema=_COUNTED)


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences (n) of each term in each (lang, source), and documents there that hold it; a row with a null term for each group."""
    small_batches(docs.sparkSession)
    empty = F.lit("")
    taken = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", "lang", "source")])
    return taken.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _packed(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x).astype(kind).tobytes()


def encoder(least_docs: int, width: int):
    """Turns the counts of a chunk into rows of ENCODED: ids and counts of each source, and for each part a row without a source, with the terms and all counts."""

    def encode(key, t):
        lang, chunk = (x.as_py() for x in key)
        distinct = t.column("term").combine_chunks().cast(pa.large_string()).dictionary_encode()
        code = distinct.indices.to_numpy(zero_copy_only=False)
        names = np.array([x.encode() for x in distinct.dictionary.to_pylist()], object)
        docs, n = t.column("docs").to_numpy(), t.column("n").to_numpy()
        kept = np.sort(names[np.bincount(code, docs, len(names)) >= least_docs])
        rows = []
        if len(kept):
            at = np.minimum(np.searchsorted(kept, names), len(kept) - 1)
            ids = np.where(kept[at] == names, at, -1)[code]
            sources: dict[str, int] = {}
            of = np.array([sources.setdefault(x, len(sources)) for x in t.column("source").to_pylist()])
            fine = np.flatnonzero(ids >= 0)
            order = fine[np.lexsort((ids[fine], of[fine], ids[fine] // width))]
            ids, of, n = ids[order], of[order], n[order]
            label = list(sources)
            cut = np.append(np.flatnonzero(np.append(True, (ids[1:] // width != ids[:-1] // width) | (of[1:] != of[:-1]))), len(ids))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = int(ids[a]) // width
                rows.append((lang, chunk, part, min(width, len(kept) - part * width), label[of[a]], int(n[a:b].sum()), _packed(ids[a:b] % width, "<i4"), _packed(n[a:b], "<i8"), None))
            totals = np.bincount(ids, n, len(kept)).astype(np.int64)
            for part, a in enumerate(range(0, len(kept), width)):
                here = totals[a : a + width]
                rows.append((lang, chunk, part, len(here), None, int(here.sum()), _packed(np.arange(len(here)), "<i4"), _packed(here, "<i8"), [x.decode() for x in kept[a : a + width]]))
        return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ENCODED)})

    return encode


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + SMOOTHING) / (total + SMOOTHING * terms)), by long division."""
    whole = total + SMOOTHING * terms
    out, rest = np.divmod(counts + SMOOTHING, whole)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def comparer(most: int):
    """Distances over one part between the sources of one tile, or of two, and the part's first terms of each source."""

    def compare(key, t):
        lang, _, _, one, two = (x.as_py() for x in key)
        rows = sorted(t.to_pylist(), key=lambda r: (r["source"] is None, r["source"] or ""))
        width, vocabulary = rows[0]["width"], rows[0]["terms_in_lang"]
        dense = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            if r["ids"] is not None:
                dense[i, np.frombuffer(r["ids"], "<i4")] = np.frombuffer(r["counts"], "<i8")
        p = shares(dense, np.array([[r["total"]] for r in rows], np.int64), vocabulary) if width else dense
        kinds, lists, values = [], [], []

        def tell(kind: str, source: str, items: list[str], found: np.ndarray) -> None:
            kinds.extend([kind] * len(items))
            lists.extend((source, x) for x in items)
            values.append(found)

        own = [i for i, r in enumerate(rows) if r["source"] is not None]
        for i in own:
            others = [j for j in own if j > i] if one == two else [j for j in own if rows[j]["tile"] == two] if rows[i]["tile"] == one else []
            if others:
                tell("pair", rows[i]["source"], [rows[j]["source"] for j in others], np.abs(p[others] - p[i]).sum(axis=1))
        if one == two and width:
            whole = rows[-1]  # the language's own row has no source
            for i in own:
                more = p[i] - p[-1]
                at = np.flatnonzero((dense[i] > 0) & (more > 0))
                at = at[np.lexsort((at, -more[at]))][:most]
                tell("term", rows[i]["source"], [whole["terms"][x] for x in at.tolist()], more[at])
        found = np.concatenate(values) if values else np.zeros(0, np.int64)
        columns = [kinds, [lang] * len(kinds), [s for s, _ in lists], [x for _, x in lists], found]
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_FOUND, columns, strict=True)})

    return compare


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, width: int = WIDTH, tile: int = TILE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: each source's distance to the others of its language, and the terms that it has more of than the language."""
    spark = docs.sparkSession
    counts = written(term_counts(docs), "terms")
    many, size = counts.filter("term is not null").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term").cast("long")), F.lit(0))).first()
    chunks = max(1, -(-many // chunk_rows), -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk")
    dealt = counts.filter("term is not null").select("lang", chunk, "source", "term", "docs", "n")
    encoded = written(dealt.groupBy("lang", "chunk").applyInArrow(encoder(least_docs, width), ENCODED), "encoded")

    groups = counts.filter("term is null").select("lang", "source")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = max(1, -(-most // tile))
    whole = encoded.filter("source is null")
    sums = encoded.filter("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    langs = groups.select("lang").distinct().join(whole.groupBy("lang").agg(F.sum("width").alias("v"), F.sum("total").alias("all")), "lang", "left").fillna(0, ["v", "all"])
    langs = langs.select("lang", F.col("v").alias("terms_in_lang"), "all")
    groups = groups.join(sums, ["lang", "source"], "left").fillna(0, ["total"]).withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int"))
    groups = written(groups, "groups")
    # every source meets every part of its language, whether it has counts there or not; languages without terms have one empty part
    parts = whole.select("lang", "chunk", "part", "width").unionByName(langs.filter("terms_in_lang = 0").select("lang", F.lit(0).alias("chunk"), F.lit(0).alias("part"), F.lit(0).alias("width")))
    grid = parts.join(groups, "lang").join(encoded.filter("source is not null").select("lang", "chunk", "part", "source", "ids", "counts"), ["lang", "chunk", "part", "source"], "left")
    grid = grid.select("lang", "chunk", "part", "width", "source", "tile", "total", "ids", "counts", F.lit(None).cast("array<string>").alias("terms"))
    own = whole.select("lang", "chunk", "part", "width", F.lit(None).cast("string").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(None).cast("long").alias("total"), "ids", "counts", "terms")
    own = own.join(langs.select("lang", "all"), "lang").select(*[F.col("all").alias("total") if c == "total" else c for c in grid.columns])
    with_other = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda x: F.struct(F.least(x, F.col("tile")).alias("one"), F.greatest(x, F.col("tile")).alias("two")))
    met = grid.withColumn("t", F.explode(with_other)).unionByName(own.withColumn("t", F.struct(F.col("tile").alias("one"), F.col("tile").alias("two"))))
    met = met.join(langs.select("lang", "terms_in_lang"), "lang").select("lang", "chunk", "part", F.col("t.one").alias("one"), F.col("t.two").alias("two"), "width", "terms_in_lang", "source", "tile", "total", "ids", "counts", "terms")
    found = written(met.groupBy("lang", "chunk", "part", "one", "two").applyInArrow(comparer(terms), FOUND), "divergence")
    dropped(counts, encoded, groups)

    pairs = found.filter("kind = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("i")), F.struct(F.col("item").alias("s"), F.col("source").alias("i"))))
    pairs = pairs.withColumn("p", both).select("lang", F.col("p.s").alias("source"), F.lit("pair").alias("part"), F.col("p.i").alias("item"), "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    words = found.filter("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= terms)
    return pairs.unionByName(words)
