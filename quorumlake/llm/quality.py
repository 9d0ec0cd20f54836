"""Quality rules (operator 8): rules on each document, and cross-document line frequency.

Lines are hashed in a normalised form (ASCII lower case, digits as one class, white space squeezed). Of each host the
distinct documents that hold a line are counted, copies of one text once, so that a text that was merely copied loses
nothing. Lines over the host's limit are boilerplate; a document that is left with too few words without them is depleted
and rejected.

Defined results: a null or empty text has no words and fails the base rules. A null host is a host of its own. Repeated
rows and equal doc_ids are judged row by row. Further columns of the input do not matter; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import own_names, small_batches, written
from .textkernel import SPACE, WORD_BASES, Prefixes, Texts, covered, in_doc, mix, slice_hashes, steps, windows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate in a host if more than so many of its distinct documents hold it, whatever the host's size: authors
#: quote a passage in a few documents, a template's line stands in as many as there are pages.
LINE_DOCS = 20
#: Share of a document's words that must be left without boilerplate.
LEAST_LEFT = 0.3

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48

STATS = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def _per_doc(t: Texts, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights, minlength=t.count).astype(np.int64)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def _lines(t: Texts) -> tuple[np.ndarray, ...]:
    """Start, end, text, first word and end of words of each line that has words."""
    start, end, _ = t.words()
    # lines: from a text's start or after a newline, to the next newline or the text's end
    breaks = np.flatnonzero(t.data == 10)
    first = np.concatenate([t.offsets[:-1], breaks + 1])
    last = np.concatenate([breaks, t.offsets[1:]])
    line_doc = np.concatenate([np.arange(t.count), t.doc_of(breaks) if len(breaks) else np.zeros(0, np.int64)])
    order = np.lexsort((first, line_doc))
    first, line_doc = first[order], line_doc[order]
    # ends in order: those of a text are its newlines, then its own end
    end_doc = np.concatenate([t.doc_of(breaks) if len(breaks) else np.zeros(0, np.int64), np.arange(t.count)])
    last = last[np.lexsort((last, end_doc))]
    w0, w1 = np.searchsorted(start, first), np.searchsorted(start, last)
    full = w1 > w0
    return tuple(x[full] for x in (first, last, line_doc, w0, w1))


def _normal(t: Texts, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """Hashes of lines in their normalised form."""
    return mix(Prefixes(t.word_hashes(0, _NORMAL), WORD_BASES[0]).of(w0, w1) + (w1 - w0).astype(np.uint64))


def text_stats(t: Texts) -> dict[str, object]:
    """Counts of each text, and its distinct normalised lines with their words."""
    start, end, doc = t.words()
    n_words = _per_doc(t, doc)
    inside = ~SPACE[t.data] & ((t.data & 0xC0) != 0x80)
    symbols = SYMBOL[t.data]

    def by_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[t.offsets[1:]] - total[t.offsets[:-1]]

    at, keys = windows(t.word_hashes(), doc, 3)
    repeated = covered(len(doc), at[_repeats(in_doc(keys, doc[at]))], 3)

    first, last, line_doc, w0, w1 = _lines(t)
    keys = in_doc(slice_hashes(t.data, first, last), line_doc)
    _, seen = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[seen] = False

    normal = _normal(t, w0, w1)
    # distinct lines of each text, with the words of all their occurrences
    keys = in_doc(normal, line_doc)
    _, seen, which = np.unique(keys, return_index=True, return_inverse=True)
    words = np.bincount(which, (w1 - w0).astype(float), minlength=len(seen)).astype(np.int32)
    by_doc = np.lexsort((seen, line_doc[seen]))
    seen, words = seen[by_doc], words[by_doc]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(line_doc[seen], minlength=t.count))]).astype(np.int32)
    whole = slice_hashes(t.data, t.offsets[:-1], t.offsets[1:])
    items = pa.StructArray.from_arrays([pa.array(normal[seen].view(np.int64)), pa.array(words)], names=["line", "words"])
    return {
        "text_hash": whole.view(np.int64), "n_words": n_words, "word_chars": by_text(inside), "n_symbols": by_text(symbols),
        "n_dup_lines": _per_doc(t, line_doc[later]), "n_repeat_words": _per_doc(t, doc[repeated]), "lines": pa.ListArray.from_arrays(pa.array(offsets), items),
    }


def document_stats(docs: DataFrame, host: str = "source", extra: list[str] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text and the host's column), as in STATS, with columns of docs named in extra."""
    small_batches(docs.sparkSession)
    extra = extra or []

    def stats(batches):
        for batch in batches:
            for t in steps(batch.column("text")):
                cut = batch.slice(t.rows.start, t.count)
                found = text_stats(t)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("host"), *[x if isinstance(x, pa.Array) else pa.array(x) for x in found.values()], *[cut.column(f"_x{i}") for i in range(len(extra))]],
                    names=["doc_id", "host", *found, *[f"_x{i}" for i in range(len(extra))]],
                )

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text", *[F.col(x).alias(f"_x{i}") for i, x in enumerate(extra)])
    return taken.mapInArrow(stats, STATS + "".join(f", _x{i} {docs.schema[x].dataType.simpleString()}" for i, x in enumerate(extra)))


def judged_rows(docs: DataFrame, host: str = "source", least_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT, extra: list[str] | None = None) -> DataFrame:
    """quality_rules, with gone: the hashes of a row's boilerplate lines, null where it has none.

    A line counts in a host with more than least_docs distinct documents that hold it. Lines meet the frequent ones by host and
    line, so that no host's list, which grows with the host, is held in one row.
    """
    stats = written(document_stats(docs, host, extra), "quality")  # read more than once below
    lines = stats.select("host", "text_hash", F.explode("lines").alias("l")).select("host", "text_hash", "l.line", "l.words")
    counts = lines.select("host", "text_hash", "line").distinct().groupBy(F.col("host").alias("of_host"), F.col("line").alias("of_line")).agg(F.count("*").alias("n")).filter(F.col("n") > least_docs)
    common = written(counts.select("of_host", "of_line"), "quality-lines")
    found = lines.join(common, lines.host.eqNullSafe(common.of_host) & (lines.line == common.of_line)).select("host", "text_hash", "line", "words").distinct()
    found = found.groupBy(F.col("host").alias("in_host"), F.col("text_hash").alias("in_text")).agg(F.sum("words").cast("long").alias("removed"), F.collect_set("line").alias("gone"))
    judged = stats.join(found, stats.host.eqNullSafe(found.in_host) & (stats.text_hash == found.in_text), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        F.coalesce("removed", F.lit(0).cast("long")).alias("n_boilerplate_words"),
        *[F.col(f"_x{i}").alias(x) for i, x in enumerate(extra or [])], "gone",
    ).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_boilerplate_words") >= least_left * F.col("n_words")))


def quality_rules(docs: DataFrame, host: str = "source", least_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT, extra: list[str] | None = None) -> DataFrame:
    """Each row's counts, base_failed, words in boilerplate lines (n_boilerplate_words) and verdict (kept); extra: columns of docs to pass on."""
    return judged_rows(docs, host, least_docs, least_left, extra).drop("gone")


def without_lines(t: Texts, gone: list[list[int] | None]) -> list[str]:
    """The texts without the lines whose hashes are given for each."""
    out = [t.data[a:b].tobytes() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)]
    first, _, line_doc, w0, w1 = _lines(t)
    ends = np.searchsorted(line_doc, np.arange(t.count + 1))
    hashes = _normal(t, w0, w1).view(np.int64)
    for i, mine in enumerate(gone):
        if mine:
            at = slice(ends[i], ends[i + 1])
            drop = set((first[at][np.isin(hashes[at], np.array(mine, np.int64))] - t.offsets[i]).tolist())
            kept, place = [], 0
            for line in out[i].split(b"\n"):
                if place not in drop:
                    kept.append(line)
                place += len(line) + 1
            out[i] = b"\n".join(kept)
    return [x.decode("utf-8", "replace") for x in out]


def clean_documents(docs: DataFrame, host: str = "source", least_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The rows of docs that the rules keep, all columns, their texts without boilerplate lines; other lines stay byte by byte.

    A row's verdict depends on its host and text alone, and finds it by doc_id, host and text.
    """
    names = docs.columns
    host_, key, of_id, of, of_text, gone_ = own_names(names, "_host", "_key", "_id", "_of", "_text", "_gone")
    same = docs.withColumns({host_: F.col(host).cast("string"), key: F.xxhash64(F.coalesce("text", F.lit("")))})
    judged = judged_rows(same.select("doc_id", "text", F.col(host_).alias("host"), F.col(key).alias("key")), "host", least_docs, least_left, ["host", "key"])
    good = judged.filter("kept").select(F.col("doc_id").alias(of_id), F.col("host").alias(of), F.col("key").alias(of_text), F.col("gone").alias(gone_)).dropDuplicates([of_id, of, of_text])
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & F.col(host_).eqNullSafe(F.col(of)) & (F.col(key) == F.col(of_text))
    kept = same.join(good, on).select(*names, gone_)

    def strip(batches):
        for batch in batches:
            for t in steps(batch.column("text")):
                cut = batch.slice(t.rows.start, t.count)
                gone = cut.column(gone_).to_pylist()
                columns = {c: cut.column(c) for c in names}
                if any(gone):
                    columns["text"] = pa.array(without_lines(t, gone), cut.schema.field("text").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return kept.mapInArrow(strip, docs.schema)
