"""The stage graph: edges, closure, validation and lookups. Edge u -> v carries v's own delay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.stored import fits_broadcast, kept


def edges(stages: DataFrame) -> DataFrame:
    return stages.select(F.explode("upstream_ids").alias("src"), F.col("stage_id").alias("dst"), F.col("propagation_delay_ms").alias("delay_ms"))


def small(table: DataFrame) -> DataFrame:
    """A stored table of stages or pairs of stages, with a broadcast hint if its rows are few enough."""
    return F.broadcast(table) if fits_broadcast(table, 64, 128 << 20) else table


def stored_graph(stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stages, a row each with its upstreams, and (feeder): the stages that feed others."""
    g = kept(stages, "graph-stages")
    return g, kept(edges(g).select(F.col("src").alias("feeder")).distinct(), "graph-feeders")


def pairs(e: DataFrame) -> DataFrame:
    """(descendant, ancestor, hops, delay_ms) of edges, stored. Rounds of minima: only pairs that the last round found or bettered
    are carried one edge further, and of all paths of a pair its minima go on, so the work grows with pairs and not with
    paths. Cycles end too, as long as delays aren't negative."""
    e = kept(e.groupBy("src", "dst").agg(F.min("delay_ms").alias("d")), "graph-edges")
    known = front = kept(e.select(F.col("dst").alias("descendant"), F.col("src").alias("ancestor"), F.lit(1).alias("hops"), F.col("d").alias("delay_ms"), F.lit(True).alias("new")), "graph-pairs")
    while not front.isEmpty():
        met = front.join(e, front.ancestor == e.dst).select("descendant", F.col("src").alias("ancestor"), (F.col("hops") + 1).alias("hops"), (F.col("delay_ms") + F.col("d")).alias("delay_ms"), F.lit(True).alias("new"))
        known = kept(bettered(known, met, "descendant", "ancestor"), "graph-pairs")
        front = known.filter("new")
    return known.select("descendant", "ancestor", "hops", "delay_ms")


def bettered(known: DataFrame, met: DataFrame, *key: str) -> DataFrame:
    """The minima of what is known and what a round met; new: the round found or bettered them."""
    both = known.withColumn("new", F.lit(False)).unionByName(met).groupBy(*key).agg(
        F.min("hops").alias("hops"), F.min("delay_ms").alias("delay_ms"), F.min(F.when(~F.col("new"), F.col("hops"))).alias("h"), F.min(F.when(~F.col("new"), F.col("delay_ms"))).alias("l"),
    )
    better = F.col("h").isNull() | (F.col("hops") < F.col("h")) | (F.col("delay_ms") < F.col("l"))
    return both.select(*key, "hops", "delay_ms", better.alias("new"))


def closure(stages: DataFrame) -> DataFrame:
    """(descendant, ancestor, hops, delay_ms): least hops and least summed delay, each over all paths. Rounds run only over edges
    between stages that feed others. Every path to a stage that feeds none is one of theirs, or none, and a last edge, so
    those stages, mostly the bulk of a graph, are met once and shuffled once, each with its upstreams in one row."""
    g, feeders = stored_graph(stages.select("stage_id", "upstream_ids", "propagation_delay_ms"))
    feeds = small(feeders)
    known = pairs(edges(g.join(feeds, F.col("stage_id") == F.col("feeder"), "left_semi")))
    own = feeders.select(F.col("feeder").alias("by"), F.col("feeder").alias("ancestor"), F.lit(0).alias("h"), F.lit(0.0).alias("l"))
    reach = kept(known.toDF("by", "ancestor", "h", "l").union(own), "graph-reach")
    ends = edges(g.join(feeds, F.col("stage_id") == F.col("feeder"), "left_anti").repartition("stage_id"))
    met = ends.join(small(reach), F.col("src").eqNullSafe(F.col("by"))).select(F.col("dst").alias("descendant"), "ancestor", (F.col("h") + 1).alias("hops"), (F.col("l") + F.col("delay_ms")).alias("delay_ms"))
    return known.union(met.groupBy("descendant", "ancestor").agg(F.min("hops").alias("hops"), F.min("delay_ms").alias("delay_ms")))


def walk(e: DataFrame, start: DataFrame, on: DataFrame | None = None) -> DataFrame:
    """(node, hops, delay_ms): least hops and least summed delay of the nodes that edges (at, to, d) lead to from any of the start (at).
    on (feeder): stored, the nodes with edges; others aren't followed."""
    front, known = start.select("at", F.lit(0).alias("hops"), F.lit(0.0).alias("delay_ms")), None
    while True:
        met = e.join(small(front.toDF("at", "h", "l")), "at").select(F.col("to").alias("node"), (F.col("h") + 1).alias("hops"), (F.col("l") + F.col("d")).alias("delay_ms"), F.lit(True).alias("new"))
        least = met.groupBy("node").agg(F.min("hops").alias("hops"), F.min("delay_ms").alias("delay_ms"), F.lit(True).alias("new")) if known is None else bettered(known, met, "node")
        known = kept(least, "graph-walk")
        front = known.filter("new").select("node", "hops", "delay_ms")
        if on is not None:
            front = kept(front.join(on, F.col("node") == F.col("feeder"), "left_semi"), "graph-front")
        if front.isEmpty():
            return known.select("node", "hops", "delay_ms")


def with_self(stages: DataFrame) -> DataFrame:
    own = stages.select(F.col("stage_id").alias("descendant"), F.col("stage_id").alias("ancestor"), F.lit(0).alias("hops"), F.lit(None).cast("double").alias("delay_ms"))
    return closure(stages).unionByName(own)


def ancestors(stages: DataFrame, stage_id: str) -> DataFrame:
    """One stage's rows of the closure, walked from it alone."""
    g = kept(stages.select("stage_id", "upstream_ids", "propagation_delay_ms"), "graph-stages")
    found = walk(edges(g).toDF("to", "at", "d"), g.sparkSession.range(1).select(F.lit(stage_id).alias("at")))
    return found.select(F.lit(stage_id).alias("descendant"), F.col("node").alias("ancestor"), "hops", "delay_ms").orderBy("hops", "delay_ms", "ancestor")


def descendants(stages: DataFrame, stage_id: str) -> DataFrame:
    """What the closure has under one stage, walked from it alone."""
    g, feeders = stored_graph(stages.select("stage_id", "upstream_ids", "propagation_delay_ms"))
    found = walk(edges(g).toDF("at", "to", "d"), g.sparkSession.range(1).select(F.lit(stage_id).alias("at")), feeders)
    return found.select(F.col("node").alias("descendant"), F.lit(stage_id).alias("ancestor"), "hops", "delay_ms").orderBy("hops", "delay_ms", "descendant")


def closest_ancestors(stages: DataFrame) -> DataFrame:
    """Always one of the stages one hop up, as every ancestor lies behind one of them."""
    first = closure(stages).filter("hops = 1").groupBy("descendant").agg(F.min(F.struct("hops", "delay_ms", "ancestor")).alias("one"))
    return first.select("descendant", "one.ancestor", "one.hops", "one.delay_ms")


def reached(stages: DataFrame, kind: str) -> DataFrame:
    """(stage_id, reached): how many stages each stage of a type reaches, if any."""
    n = closure(stages).groupBy("ancestor").agg(F.count("*").alias("reached"))
    some = stages.filter(F.col("stage_type") == kind).select("stage_id")
    return n.join(some, n.ancestor == some.stage_id).select("stage_id", "reached")


def components(stages: DataFrame) -> DataFrame:
    """(stage_id, component_id): weakly connected parts, named by their least stage. Each round takes the least name among a stage's
    neighbours and the stage that its name names, so names travel in leaps; names are joined, never collected."""
    e = edges(stages).select("src", "dst")
    both = kept(e.union(e.select("dst", "src")).distinct(), "graph-both")
    names = kept(stages.select("stage_id", F.col("stage_id").alias("component_id")), "graph-names")
    while True:
        near = both.join(names, both.dst == names.stage_id).groupBy("src").agg(F.min("component_id").alias("near"))
        seen = names.join(near, names.stage_id == near.src, "left").select("stage_id", "component_id", F.least("component_id", "near").alias("named"))
        far = seen.select(F.col("stage_id").alias("named"), F.col("named").alias("far"))
        moved = kept(seen.join(far, "named", "left").select("stage_id", "component_id", F.least("named", "far").alias("named")), "graph-names")
        done = moved.filter("named <> component_id").isEmpty()
        names = moved.select("stage_id", F.col("named").alias("component_id"))
        if done:
            return names


def problems(stages: DataFrame) -> DataFrame:
    """(stage_id, problem) for what validate() would refuse, of a graph of any size."""
    stages, feeders = stored_graph(stages)
    e, known = edges(stages), stages.select("stage_id", F.col("stage_type").alias("type"))
    missing = kept(feeders.join(known, F.col("feeder") == F.col("stage_id"), "left_anti"), "graph-missing")
    none = e.join(small(missing), F.col("src").eqNullSafe(F.col("feeder")), "left_semi").select(F.col("dst").alias("stage_id"), F.lit("unknown upstream").alias("problem"))
    sinks = feeders.join(known.filter("type = 'sink'"), F.col("feeder") == F.col("stage_id"), "left_semi").select(F.col("feeder").alias("stage_id"), F.lit("sink has a downstream").alias("problem"))
    alone = stages.filter("stage_type = 'transform' and size(upstream_ids) = 0").join(feeders, F.col("stage_id") == F.col("feeder"), "left_anti").select("stage_id", F.lit("transform has no edge").alias("problem"))
    # a cycle's stages feed each other
    inner = edges(stages.join(small(feeders), F.col("stage_id") == F.col("feeder"), "left_semi")).withColumn("delay_ms", F.greatest("delay_ms", F.lit(0.0)))
    rings = pairs(inner).filter("descendant = ancestor").select(F.col("descendant").alias("stage_id"), F.lit("on a cycle").alias("problem"))
    fed = walk(e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0.0).alias("d")), known.filter("type = 'source'").select(F.col("stage_id").alias("at")), feeders)
    lost = known.filter("type in ('transform', 'sink')").join(fed, F.col("stage_id") == F.col("node"), "left_anti").select("stage_id", F.lit("no source reaches it").alias("problem"))
    own = F.array(
        F.when(~F.col("stage_type").isin("source", "transform", "sink"), F.lit("unknown type")), F.when(F.col("propagation_delay_ms") < 0, F.lit("negative delay")),
        F.when((F.col("stage_type") == "source") & (F.size("upstream_ids") > 0), F.lit("source has an upstream")),
    )
    mine = stages.select("stage_id", F.explode(F.array_compact(own)).alias("problem"))
    return reduce(DataFrame.union, (none, sinks, alone, rings, lost, mine)).distinct()


def validate(stages: DataFrame) -> None:
    """Raises ValueError on unknown upstreams, cycles, wrong degrees, negative delays, or stages that no source reaches."""
    rows = {r.stage_id: r for r in stages.collect()}
    kinds = {"source", "transform", "sink"}
    out = {s: 0 for s in rows}
    for s, r in rows.items():
        if r.stage_type not in kinds:
            raise ValueError(f"{s}: unknown type {r.stage_type!r}")
        if r.propagation_delay_ms < 0:
            raise ValueError(f"{s}: negative delay")
        for u in r.upstream_ids:
            if u not in rows:
                raise ValueError(f"{s}: unknown upstream {u!r}")
            out[u] += 1
    waiting = {s: len(r.upstream_ids) for s, r in rows.items()}
    ready, order = [s for s, n in waiting.items() if n == 0], []
    while ready:
        order.append(s := ready.pop())
        for t, r in rows.items():
            if s in r.upstream_ids:
                waiting[t] -= r.upstream_ids.count(s)
                if waiting[t] == 0:
                    ready.append(t)
    if len(order) < len(rows):
        raise ValueError("the graph has a cycle")
    for s, r in rows.items():
        if r.stage_type == "source" and r.upstream_ids:
            raise ValueError(f"source {s} has an upstream")
        if r.stage_type == "sink" and out[s]:
            raise ValueError(f"sink {s} has a downstream")
        if r.stage_type == "transform" and not (r.upstream_ids or out[s]):
            raise ValueError(f"transform {s} has no edge")
    for kind in ("source", "sink"):
        if not any(r.stage_type == kind for r in rows.values()):
            raise ValueError(f"no {kind}")
    reached: set[str] = set()
    for s in order:
        if rows[s].stage_type == "source" or reached & set(rows[s].upstream_ids):
            reached.add(s)
    if lost := sorted(set(rows) - reached):
        raise ValueError(f"no source reaches {lost}")
