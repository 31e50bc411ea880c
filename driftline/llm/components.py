"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is one aggregation and one join over the links; a hub's links are split by the skew join, and only its
minimum is aggregated. Links are written to the shared folder between rounds. Rounds grow with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import stored


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(e: DataFrame) -> DataFrame:
    """For each u with neighbours v: every v, and u itself, is linked to the least of them; (node, least) rows."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(least, "u")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links (u, v) of any two longs, in any order, repeats and loops allowed. Returns (node, root), root the least id
    reachable, for every linked node that isn't its own root. No links: an empty table."""
    e = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
        large = _star(_both(e)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        s = _star(large.filter("u > v"))
        small = s.select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = stored(small, name)
