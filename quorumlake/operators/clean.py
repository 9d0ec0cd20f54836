"""Dedupe, validation, upsert and keyed update of tables."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cuts import cut
from .graph import connected


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order. Null keys are a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of each key with the greatest position, by a partial aggregation that keeps one row a key in each task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def _one_by_one(rows: DataFrame, keys: list[list[str]], whole: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """(rows that an insert adds, rows of groups that are too large): groups of rows that keys connect, each decided in order by one task; so few rows that they make no large group are one group."""
    if rows.count() <= most:
        placed = rows.withColumns({"least": F.lit(0), "size": F.lit(0)})
    else:
        links = None
        for key, full in zip(keys, whole, strict=True):
            held = rows.filter(full).select(F.to_json(F.struct(*key)).alias("k"), "_id")
            star = held.join(held.groupBy("k").agg(F.min("_id").alias("b")), "k").select(F.col("_id").alias("a"), "b")
            links = star if links is None else links.unionByName(star)
        groups = connected(links)
        sizes = groups.groupBy("least").agg(F.count("*").alias("size"))
        placed = cut(rows.join(groups.join(sizes, "least"), F.col("_id") == F.col("v"), "left").drop("v"))
    small = placed.filter(F.col("size") <= most)
    taken = [F.when(full, F.to_json(F.struct(*key))).alias(f"k{i}") for i, (key, full) in enumerate(zip(keys, whole, strict=True))]
    asked = small.select("least", "_id", F.row_number().over(Window.partitionBy("least").orderBy("_at")).alias("turn"), *taken)

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group, seen, stays = group.sort_values("turn"), set(), []
        for row, *own in zip(group["_id"], *[group[f"k{i}"] for i in range(len(keys))], strict=True):
            own = {(i, k) for i, k in enumerate(own) if k is not None}
            if not own & seen:
                seen |= own
                stays.append(row)
        return pd.DataFrame({"stays": pd.Series(stays, dtype="int64")})

    stays = asked.groupBy("least").applyInPandas(decide, "stays long")
    free = placed.filter(F.col("size").isNull()).select(*rows.columns)
    return free.unionByName(small.join(stays, F.col("_id") == F.col("stays")).select(*rows.columns)), placed.filter(F.col("size") > most).select(*rows.columns)


def insert_ignore(new: DataFrame, target: DataFrame | None, keys: list[list[str]], order: list[Column], rounds: int = 3, group_rows: int = 100_000) -> DataFrame:
    """Rows of new that an insert which ignores conflicts would add, row by row in order; a key with a null in it never conflicts.

    A row goes if any of its keys is in the target or is that of a row that was added before it; a row that goes blocks
    none. Rounds find the same: a row that comes first under all of its keys is added, and the rows that share a key with
    it go; then the next ones come first. Each round is an aggregation by key, so that no key's rows meet in one task. Few
    rounds decide most rows. What is left then are chains, of which each row's going lets the next stay: they are connected
    into groups, and a group of group_rows rows at most is decided in order by one task. Larger ones go on by rounds.
    """
    names = new.columns
    whole = [reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]) for key in keys]
    left = new
    for key in keys if target is not None else ():
        left = left.join(target.select(*key).distinct(), key, "left_anti").select(*names)
    # rows equal in order get places of their own, fixed by the cut; the place is made of columns that rows have already, so that no table or shuffle of rows holds it
    left, at = cut(left.withColumn("_id", F.monotonically_increasing_id())), F.struct(*order, "_id")
    added = None
    turn = 0
    while not left.isEmpty():
        if turn == rounds:
            stays, left = _one_by_one(left.withColumn("_at", at), keys, whole, group_rows)
            left = left.drop("_at")
            added = stays.select(*names) if added is None else added.unionByName(stays.select(*names))
            turn += 1
            continue
        turn += 1
        marked = left
        for i, (key, full) in enumerate(zip(keys, whole, strict=True)):
            firsts = left.filter(full).groupBy(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)]).agg(F.min_by("_id", at).alias(f"_f{i}"))
            same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{j}") for j, k in enumerate(key)])
            marked = marked.join(firsts, same, "left").drop(*[f"_k{j}" for j in range(len(key))])
        first = [F.col(f"_f{i}").isNull() | (F.col("_id") == F.col(f"_f{i}")) for i in range(len(keys))]
        marked = cut(marked.select(*names, "_id", reduce(lambda a, b: a & b, first).alias("_stays")))
        stays = marked.filter("_stays").select(*names)
        added = stays if added is None else added.unionByName(stays)
        left = marked.filter("not _stays").select(*names, "_id")
        for key, full in zip(keys, whole, strict=True):
            left = left.join(stays.filter(full).select(*key), key, "left_anti")
        left = cut(left.select(*names, "_id"))
    return new.limit(0) if added is None else added


def insert_ignore_exact(new: DataFrame, keys: list[list[str]], group: str, order: list[Column]) -> DataFrame:
    """insert_ignore under keys that hold within a group only; rows without a group never conflict."""
    return insert_ignore(new, None, [[group, *key] for key in keys], order)


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both; where a key is in both, the new row's values hold."""
    rest = [c for c in target.columns if c not in keys]
    t, n = target.alias("t"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = t.join(n, [F.col(f"t.{k}") == F.col(f"n.{k}") for k in keys], "full")
    return joined.select(*[F.coalesce(f"t.{k}", f"n.{k}").alias(k) for k in keys], *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in rest]).select(*target.columns)


def _written_over(spark: SparkSession, path: str, rows: DataFrame, partition: str, touched: list) -> None:
    """Writes rows as the touched partitions of a table; partitions that they leave empty go, all others stay as they are."""
    rows = cut(rows)  # they come from the files that are replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    left = {r[0] for r in rows.select(partition).distinct().collect()}  # a row for each touched partition, as in touched
    for value in touched:
        if value not in left:
            jvm = spark.sparkContext._jvm
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value)) if value is not None else "__HIVE_DEFAULT_PARTITION__"
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _of(partition: str, values: list) -> Column:
    """Rows of some partitions: a condition that prunes the scan."""
    return F.col(partition).isin(*[v for v in values if v is not None]) | (F.col(partition).isNull() if None in values else F.lit(False))


def upsert_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str) -> list:
    """upsert() into a table of Parquet files by partition: only those that a new row comes to, or whose row it replaces, are read whole and written. Returns their values.

    What holds the keys now is found by a scan of keys alone. Each partition is replaced as a whole; several are not replaced at one time.
    """
    table = spark.read.parquet(path)
    new = cut(new.select(*table.columns))
    held = table.select(*keys, partition).join(new.select(*keys), keys, "left_semi").select(partition)
    touched = [r[0] for r in held.unionByName(new.select(partition)).distinct().collect()]  # a row for each partition that changes
    if touched:
        _written_over(spark, path, upsert(table.filter(_of(partition, touched)), new, keys).select(*table.columns), partition, touched)
    return touched


def update_into(spark: SparkSession, path: str, new: DataFrame, key: str, columns: list[str], partition: str) -> list:
    """keyed_update() of a table of Parquet files by partition: only those with a row that changes are read whole and written. Returns their values."""
    table = spark.read.parquet(path)
    new = cut(new)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    asked = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    changed = table.select(key, *columns, partition).join(asked, F.col(key) == F.col("_k")).filter(~reduce(lambda a, b: a & b, [same(c) for c in columns]))
    touched = [r[0] for r in changed.select(partition).distinct().collect()]  # a row for each partition that changes
    if touched:
        _written_over(spark, path, keyed_update(table.filter(_of(partition, touched)), new, key, columns), partition, touched)
    return touched


def keyed_update(target: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with columns set from new (a row a key) where it has the key."""
    n = new.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(n, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def passing_groups(df: DataFrame, group: str, valid: Column) -> DataFrame:
    """Rows of those groups (directories) in which every row is valid; one bad row fails its group."""
    verdict = df.groupBy(F.col(group).alias("_g")).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("_ok"))
    return df.join(verdict.filter("_ok"), F.col(group) == F.col("_g"), "left_semi")


def meeting_line_valid() -> Column:
    return F.col("heldOn").isNotNull() & (F.col("heldOn") != "")


def summary_line_valid() -> Column:
    return F.col("meetingId").isNotNull() & (F.col("meetingId") != "") & F.col("summary").isNotNull() & (F.col("summary") != "") & F.col("topicDigests").isNotNull()


def corrected_preferred(df: DataFrame, group: list[str], corrected: Column, exempt: Column) -> DataFrame:
    """Where a group has a corrected edition, its plain rows go, but for exempt ones."""
    best = Window.partitionBy(*group)
    return df.withColumn("_any", F.max(F.coalesce(corrected, F.lit(False))).over(best)).filter(~F.col("_any") | corrected | exempt).drop("_any")


def union_calendar_year(parts: list[DataFrame], date: str, year: int) -> DataFrame:
    """Rows of several fiscal years' lists (duplicates kept) that fall in one calendar year."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.year(date) == year)
