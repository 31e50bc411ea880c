"""Exact quantiles by range refinement: count values by cell, keep the cell that holds the wanted rank, count again inside it.

Each round is one scan of a column with a partial aggregate of at most CELLS rows for a group and range, so neither a task nor
a group's aggregate ever holds the values. Cells are equal parts of a range whose ends are values that occur; a round narrows
a range to the least and greatest value in its cell, and a rank is found when the two are one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.operators.stored import kept

CELLS = 2048


def exact_quantiles(rows: DataFrame, key: str, value: str, levels: dict[str, float], cells: int = CELLS) -> DataFrame:
    """key and a column for each level (name -> 0 to 1), interpolated between ranks as SQL's percentile does. NULLs and NaNs don't
    count; a group without any other value has no row."""
    v = F.col(value).cast("double")
    data = rows.select(F.col(key).alias("k"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    first = kept(data.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-ranges")
    place = {q: (F.col("n") - 1) * F.lit(float(q)) for q in levels.values()}
    ranks = reduce(DataFrame.union, (first.select("k", F.lit(q).alias("q"), side, edge(p).cast("long").alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")) for q, p in place.items() for side, edge in ((F.lit(0).alias("side"), F.floor), (F.lit(1).alias("side"), F.ceil))))
    state = kept(ranks, "quantile-ranks")
    while not state.filter("lo < hi").isEmpty():
        open_ = state.filter("lo < hi")
        ranges = open_.select("k", "lo", "hi", "below").distinct()
        wide = F.expr("if(isnan(hi - lo) or hi - lo > 1.7976931348623157E308D, (v / 2 - lo / 2) / (hi / 2 - lo / 2), (v - lo) / (hi - lo))")
        cell = F.least(F.floor(wide * cells).cast("int"), F.lit(cells - 1)).alias("cell")
        met = data.join(ranges, "k").filter("v >= lo and v <= hi").groupBy("k", "lo", "hi", "below", cell).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        line = Window.partitionBy("k", "lo", "hi", "below").orderBy("cell")  # cells of one range
        upto = met.withColumn("upto", F.sum("n").over(line) + F.col("below")).withColumn("from", F.col("upto") - F.col("n"))
        found = open_.join(upto, ["k", "lo", "hi", "below"]).filter("rank >= from and rank < upto")
        new = found.select("k", "q", "side", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("from").alias("below"))
        state = kept(state.filter("lo = hi").unionByName(new), "quantile-ranks")
    ends = state.join(first.select("k", "n"), "k").groupBy("k", "n", "q").agg(F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("lo"))).alias("b"))
    at = (F.col("n") - 1) * F.col("q")
    values = ends.select("k", "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("x"))
    return values.groupBy(F.col("k").alias(key)).agg(*(F.max(F.when(F.col("q") == q, F.col("x"))).alias(name) for name, q in levels.items()))
