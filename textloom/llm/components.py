"""Connected components of a link table by min-label hooking and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c) for every vertex of links: c is the least vertex reachable.

    Each round lets every vertex and every root take the least label among its neighbours'
    labels, then jumps to its label's label, so path lengths halve. Labels live in written
    tables; the driver sees one count a round, never links or labels. Groups of any size
    are reduced by partial minima only."""
    both = stored(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v")).distinct(),
        "links",
    )
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "v"), "labels")
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("c").alias("n"))
        hooked = labels.join(near.withColumnRenamed("u", "v"), "v").select("v", "c", F.least("c", "n").alias("n"))
        offers = hooked.select("v", "n").unionByName(hooked.select(F.col("c").alias("v"), "n")).groupBy("v").agg(F.min("n").alias("n"))
        jump = offers.select(F.col("v").alias("n"), F.col("n").alias("nn"))
        moved = offers.join(jump, "n", "left").select("v", F.coalesce("nn", "n").alias("c"))
        after = stored(moved, "labels")
        changed = after.join(labels.withColumnRenamed("c", "old"), "v").where("c <> old").limit(1).count()
        labels = after
        if not changed:
            return labels
