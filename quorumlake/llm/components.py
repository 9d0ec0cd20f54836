"""Connected components of links, in rounds of joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(v, comp) of every vertex of links (a, b): comp is the least vertex that links reach.

    Each round takes the least label among a vertex's own and its neighbours', and then that label's label, which halves
    the way that is left. Rounds are written, so that lineage stays short; only the number of changes comes to the driver.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near")).select("v", F.least("v", "near").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("of")).agg(F.min("comp").alias("least"))
        one = written(labels.join(near, labels.v == near.of).select("v", F.col("comp").alias("was"), F.least("comp", "least").alias("comp")), "labels")
        up = one.select(F.col("v").alias("at"), F.col("comp").alias("above"))
        jumped = written(one.join(up, one.comp == up.at).select("v", "was", F.least("comp", "above").alias("comp")), "labels")
        dropped(labels, one)
        labels = jumped
        if not jumped.filter("was <> comp").limit(1).count():
            dropped(both)
            return labels.select("v", "comp")
