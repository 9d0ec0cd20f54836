"""Connected groups of rows, in a number of rounds that grows with the logarithm of a group's length."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import cut


def connected(links: DataFrame) -> DataFrame:
    """(v, least) of each vertex of links (a, b): the least vertex that links reach from it.

    Vertices carry labels. In a round every label that has a smaller one next to any of its vertices is hooked to the least
    of these; the hooks are followed to their ends, by leaps that double, and all labels are replaced. Of two neighbouring
    labels one is hooked at least, so that a round leaves half of the labels of a group at most.
    """
    ways = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(ways.select(F.col("a").alias("v")).distinct().withColumn("least", F.col("v")))
    while True:
        near = labels.select(F.col("v").alias("b"), F.col("least").alias("near"))
        around = ways.join(near, "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        hooks = cut(labels.join(around, "v").groupBy("least").agg(F.min("near").alias("to")).filter("to < least"))
        if hooks.isEmpty():
            return labels
        while True:
            ends = hooks.select(F.col("least").alias("to"), F.col("to").alias("end"))
            leapt = cut(hooks.join(ends, "to", "left").select("least", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")))
            hooks = leapt.select("least", "to")
            if leapt.filter("moved").isEmpty():
                break
        labels = cut(labels.join(hooks, "least", "left").select("v", F.coalesce("to", "least").alias("least")))
