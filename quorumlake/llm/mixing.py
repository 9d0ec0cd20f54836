"""Mixing sources to target weights (operator 7): entropy balancing, by DataFrame operations only.

Of all rates r of documents that meet each source's token constraint sum(size * r) = target with 0 <= r <= cap, those
nearest to 1 by relative entropy are the exponentially tilted r = min(cap, exp(lambda * size)), lambda being the dual's
solution for the constraint of the document's source. The dual is convex; Newton steps find it, each an aggregation of
gradient and curvature. Documents of a source that are equal in size have equal rates, so that a table of (source, size,
number of documents) is all that the steps read.

The rates are rounded into copies: along a source's sizes, a running sum of rates is cut at whole numbers, which gives the
copies of all documents of one size together; neighbours, alike in size, make up for each other. What a source's tokens
then differ from its target by, a document's size or so, single copies are added or taken for, until none brings the source
nearer: the rest is then at most half the size of the smallest document that may still gain (or lose) a copy. The copies of a size are dealt evenly to its documents in the order of a hash.

Defined results: a null or empty text has size 0 and takes nothing. A null source is a source of its own, last in order.
A source without any words has target 0. Repeated rows are documents like others. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions
from .storage import dropped, written

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton steps at most, of which so many make one job, and the relative error of a source's tokens at which they end.
NEWTON_STEPS = 60
STEPS_A_JOB = 3
TOLERANCE = 1e-9
#: Sizes between two powers of two that a correcting pass looks at.
CHOICES = 4
#: Rates are summed as whole numbers of this part, so that the order of summation does not matter.
PART = 1 << 24


def document_sizes(docs: DataFrame, source: str = "source", extra: list[str] | None = None) -> DataFrame:
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("size"), *(extra or []))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with target: shares by weight of all sizes; what goes over cap times a source's size is shared anew by weight."""
    one = sources.withColumn("one", F.lit(1).cast("long"))
    ranked = positions(one, [F.col("source").asc_nulls_last()], {"rank": "one"}, name="sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")), "weights")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    # a source is full if its share per weight is over most / weight; the level only rises, so each round fills more or ends
    level, filled = 0.0, -1
    while True:
        full = F.col("most") < level * F.col("weight")
        count, taken, weight = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if count == filled or not weight:
            break
        level, filled = (total - taken) / weight, count
    return ranked.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def _exact_sum(x: Column) -> Column:
    """A sum of doubles that does not depend on their order: as decimals."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def entropy_rates(sizes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(of, tilt) of each source (of), by Newton steps on the dual; tilt is null where all rates are cap, or all are 0. sizes: (source, size, n).

    A step solves for the logarithm of a source's tokens, which is convex in the tilt while no rate is at cap; tilts known
    to be too low and too high bound it.
    """
    open_ = (F.col("target") > 0) & (F.col("target") < F.lit(float(cap)) * F.col("source_size"))
    none = F.lit(None).cast("double")
    state = targets.select(F.col("source").alias("of"), "target", F.when(open_, 0.0).alias("tilt"), none.alias("low"), none.alias("high"))
    tilted = F.exp(F.least(F.log(F.lit(float(cap))), F.col("tilt") * F.col("size")))
    below = F.col("tilt") * F.col("size") < F.log(F.lit(float(cap)))
    held = None
    for _ in range(0, NEWTON_STEPS, STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            joined = state.join(sizes, sizes.source.eqNullSafe(state.of), "left")
            tokens = F.col("n") * F.col("size") * tilted
            sums = joined.groupBy("of", "target", "tilt", "low", "high").agg(_exact_sum(tokens).alias("made"), _exact_sum(F.when(below, tokens * F.col("size")).otherwise(0.0)).alias("curve"))
            sums = sums.withColumns({"low": F.when(F.col("made") <= F.col("target"), F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("made") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))})
            step = F.col("tilt") + F.log(F.try_divide("target", "made")) * F.try_divide("made", "curve")
            inside = step.isNotNull() & (F.col("low").isNull() | (step >= F.col("low"))) & (F.col("high").isNull() | (step <= F.col("high")))
            move = F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
            state = sums.select("of", "target", F.coalesce(move, "tilt").alias("tilt"), "low", "high", F.when(F.col("tilt").isNotNull(), F.abs(F.try_divide("made", "target") - 1)).alias("error"))
        state = written(state, "newton")
        dropped(held)
        held = state
        if (state.agg(F.max("error")).first()[0] or 0.0) < TOLERANCE:
            break
    return state.select("of", "tilt")


def copies_of_sizes(sizes: DataFrame, targets: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, rate, copies): copies of all n documents of a size together, their running sum along the sizes cut at whole numbers."""
    at = F.when(F.col("tilt").isNotNull(), F.exp(F.least(F.log(F.lit(float(cap))), F.col("tilt") * F.col("size")))).when(F.col("target") > 0, float(cap)).otherwise(0.0)
    told = targets.select(F.col("source").alias("of"), "target").join(tilts.select(F.col("of").alias("tilt_of"), "tilt"), F.col("of").eqNullSafe(F.col("tilt_of")))
    rated = sizes.join(told, sizes.source.eqNullSafe(told.of)).select("source", "size", "n", F.when(F.col("size") > 0, at).otherwise(0.0).alias("rate"))
    rated = rated.withColumn("parts", F.round(F.col("rate") * PART).cast("long") * F.col("n"))
    placed = positions(rated, [F.col("source"), F.col("size")], {"before": "parts"}, ["source"], name="rates")
    whole = lambda x: F.floor((x + PART // 2) / PART)
    return placed.select("source", "size", "n", "rate", F.least(whole(F.col("before") + F.col("parts")) - whole(F.col("before")), cap * F.col("n")).cast("long").alias("copies"))


def corrected(rounded: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """rounded with copies added (or taken) singly, largest documents first, until none brings its source nearer to target.

    In a pass a source looks at the CHOICES smallest sizes between each two powers of two; so a source's list is short,
    however many sizes it has.
    """
    rounded = written(rounded, "copies")
    while True:
        taken = rounded.groupBy(F.col("source").alias("t")).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        rest = targets.join(taken, targets.source.eqNullSafe(taken.t)).select(F.col("source").alias("of"), (F.col("target") - F.col("taken")).alias("rest"))
        room = F.when(F.col("rest") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        could = rounded.join(rest, rounded.source.eqNullSafe(rest.of)).filter((F.col("size") > 0) & (F.col("size") < 2 * F.abs("rest"))).withColumn("room", room).filter("room > 0")
        nth = F.row_number().over(Window.partitionBy("source", F.floor(F.log2("size"))).orderBy("size"))
        could = could.withColumn("nth", nth).filter(F.col("nth") <= CHOICES).groupBy("source", "rest").agg(F.sort_array(F.collect_list(F.struct("size", "room")), False).alias("choices"))
        none = F.array().cast("array<struct<size:bigint,room:bigint,by:bigint>>")

        def take(so_far, x):
            by = F.least(x["room"], F.floor(so_far["left"] / x["size"]))
            return F.struct((so_far["left"] - by * x["size"]).alias("left"), F.concat(so_far["moves"], F.array(F.struct(x["size"].alias("size"), x["room"].alias("room"), by.alias("by")))).alias("moves"))

        start = F.struct(F.abs("rest").alias("left"), none.alias("moves"))
        could = could.withColumn("f", F.aggregate("choices", start, take)).select("source", F.signum("rest").cast("long").alias("sign"), "f.left", "f.moves")
        # one more copy, if it goes over the target by less than is left
        over = F.array_min(F.transform(F.filter("moves", lambda x: (x["by"] < x["room"]) & (x["size"] < 2 * F.col("left"))), lambda x: F.struct(F.abs(F.col("left") - x["size"]).alias("then"), x["size"].alias("size"))))
        could = could.withColumn("over", over["size"])
        each = could.select(F.col("source").alias("of_source"), "sign", "over", F.explode("moves").alias("m"))
        each = each.select("of_source", F.col("m.size").alias("move"), (F.col("sign") * (F.col("m.by") + F.when(F.col("m.size") == F.col("over"), 1).otherwise(0))).alias("by")).filter("by <> 0")
        each = written(each, "moves")
        if not each.limit(1).count():
            dropped(each)
            return rounded
        same = rounded.source.eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("move"))
        more = written(rounded.join(each, same, "left").select("source", "size", "n", "rate", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies")), "copies")
        dropped(rounded, each)
        rounded = more


def mix_sources(docs: DataFrame, source: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, extra: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of each row of docs, and its columns named in extra."""
    extra = extra or []
    named = docs.select("doc_id", source, "text", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)])
    names = [f"_x{i}" for i in range(len(extra))]
    rows = written(document_sizes(named, source, names), "sizes")
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = written(source_targets(sources, weights, cap), "targets")
    tilts = entropy_rates(sizes, targets, cap)
    copies = corrected(copies_of_sizes(sizes, targets, tilts, cap), targets, cap)
    dropped(sizes)
    # a document's number among those of its source, less that of the first of its size
    firsts = positions(copies, [F.col("source"), F.col("size")], {"first": "n"}, ["source"], name="firsts")
    firsts = firsts.select(F.col("source").alias("of"), F.col("size").alias("of_size"), "n", "rate", F.col("copies").alias("all"), "first")
    per_source = targets.select(F.col("source").alias("s"), "source_size", "target")
    firsts = written(firsts.join(per_source, firsts.of.eqNullSafe(per_source.s)).drop("s"), "mix")
    one = rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_turn", F.xxhash64("doc_id", *names))
    ranked = positions(one, [F.col("source"), F.col("size"), F.col("_turn"), F.col("doc_id")], {"rank": "_one"}, ["source"], name="mixing")
    dropped(rows)
    joined = ranked.join(firsts, ranked.source.eqNullSafe(firsts.of) & (ranked["size"] == firsts.of_size))
    more = (F.col("rank") - F.col("first") < F.col("all") % F.col("n")).cast("long")
    joined = joined.select("doc_id", "source", "size", "source_size", "target", "rate", (F.floor(F.col("all") / F.col("n")) + more).cast("long").alias("copies"), *names)
    joined = joined.withColumn("taken", F.col("copies") * F.col("size"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", *[F.col(x).alias(c) for x, c in zip(names, extra, strict=True)])
