"""From anomalies to decisions: sessions, correlated alerts, root-cause ranking and the choice of an action."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.config import CollectorConfig, CorrelationConfig
from driftline.functions.metrics import severity
from driftline.operators import topology

EVIDENCE = ("detector_type", "stage_id", "metric", "signal", "detector_value", "threshold", "z_score", "detected_at", "fault_label")


def between_gaps(rows: DataFrame, keys: list[str], gap_us: int, bucket_s: int = 86_400) -> DataFrame:
    """(keys, t, n, start): the times t of rows (keys, t) of each key, how many rows have them, and where the run of times without a
    gap of more than gap_us began. Gaps are looked for inside buckets of bucket_s: only a row for each bucket (its last time, its
    last start) is carried to the next ones."""
    times = rows.groupBy(*keys, "t").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("t") / (bucket_s * 1_000_000)))
    line, own = Window.partitionBy(*keys).orderBy("b"), Window.partitionBy(*keys, "b").orderBy("t")
    last = times.groupBy(*keys, "b").agg(F.max("t").alias("last")).select(*keys, "b", F.lag("last").over(line).alias("before"))
    since = F.col("t") - F.coalesce(F.lag("t").over(own), F.col("before"))
    flagged = times.join(last, [*keys, "b"]).withColumn("first", F.when(since.isNull() | (since > gap_us), F.col("t")))
    carried = flagged.groupBy(*keys, "b").agg(F.max("first").alias("s")).select(*keys, "b", F.max("s").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return flagged.join(carried, [*keys, "b"]).select(*keys, "t", "n", F.coalesce(F.max("first").over(own), "carried").alias("start"))


def sessions(anomalies: DataFrame, config: CollectorConfig | None = None, bucket_s: int = 86_400) -> DataFrame:
    """Anomalies with the hypothesis they belong to. A window closes when the next anomaly comes more than gap_s later;
    windows below min_events are dropped. Sessions are global by definition; see between_gaps for how they are cut in parallel."""
    config = config or CollectorConfig()
    named = between_gaps(anomalies.select(F.unix_micros("detected_at").alias("t")), [], int(config.gap_s * 1_000_000), bucket_s)
    found = named.groupBy("start").agg(F.sum("n").alias("evidence_count"), F.timestamp_micros(F.min("t")).alias("triggered_at"), F.timestamp_micros(F.max("t")).alias("closed_at"))
    return found.filter(F.col("evidence_count") >= config.min_events).select(hypothesis_id("triggered_at").alias("hypothesis_id"), "triggered_at", "closed_at", "evidence_count")


def hypothesis_id(t: str):
    """The same id whenever the job runs again."""
    return F.substring(F.sha2(F.concat(F.lit("hypothesis:"), F.unix_micros(t).cast("string")).cast("binary"), 256), 1, 32)


def evidence(anomalies: DataFrame, hypotheses: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Each anomaly with its hypothesis: an interval join made an equi-join on time buckets (hypotheses don't overlap,
    and each is listed once for each bucket that it touches)."""
    b = lambda t: F.floor(F.unix_timestamp(t) / bucket_s)
    h = hypotheses.select("hypothesis_id", "triggered_at", "closed_at", F.explode(F.sequence(b("triggered_at"), b("closed_at"))).alias("_b"))
    a = anomalies.withColumn("_b", b("detected_at"))
    return a.join(h, (a._b == h._b) & (a.detected_at >= h.triggered_at) & (a.detected_at <= h.closed_at)).select(*anomalies.columns, "hypothesis_id", "triggered_at")


def evidence_lists(ev: DataFrame) -> DataFrame:
    """(hypothesis_id, evidence): each hypothesis' anomalies in order of time."""
    return ev.groupBy("hypothesis_id").agg(F.sort_array(F.collect_list(F.struct(*PROOF))).alias("evidence"))


def scores(ev: DataFrame, stages: DataFrame) -> DataFrame:
    """(hypothesis_id, candidate, score): the closure, self rows included, turns the graph search into one broadcast join
    (the graph is a declared configuration)."""
    near = F.broadcast(topology.with_self(stages))
    known = F.broadcast(stages.select("stage_id"))
    ev = ev.join(known, "stage_id", "left_semi").select("hypothesis_id", "stage_id", "detected_at")
    first = ev.groupBy("hypothesis_id", F.col("stage_id").alias("candidate")).agg(F.min("detected_at").alias("seen"))
    pairs = ev.join(near, ev.stage_id == near.descendant).select("hypothesis_id", F.col("ancestor").alias("candidate"), "hops", "delay_ms", "detected_at")
    timed = pairs.join(first, ["hypothesis_id", "candidate"], "left")
    lag = (F.unix_micros("detected_at") - F.unix_micros("seen")) / 1000.0
    timing = F.when(F.col("seen").isNull(), 1.0).when(lag < 0, 0.5).when(F.abs(lag - F.col("delay_ms")) <= F.greatest(0.5 * F.col("delay_ms"), F.lit(100.0)), 2.0).otherwise(1.0)
    part = F.when(F.col("hops") == 0, 1.0).otherwise(timing / (F.col("delay_ms") + 1))
    return timed.groupBy("hypothesis_id", "candidate").agg(F.sum(part).alias("score"))


def localize(ev: DataFrame, stages: DataFrame) -> DataFrame:
    """(hypothesis_id, stage_id, score, posterior_probability, rank)."""
    s = scores(ev, stages)
    w = Window.partitionBy("hypothesis_id")
    total, n = F.sum("score").over(w), F.count("*").over(w)
    p = s.withColumn("posterior_probability", F.when(total == 0, 1.0 / n).otherwise(F.col("score") / total))
    rank = F.row_number().over(w.orderBy(F.desc(F.round("posterior_probability", 9)), "candidate"))
    return p.select("hypothesis_id", F.col("candidate").alias("stage_id"), "score", "posterior_probability", rank.alias("rank"))


def localizations(hypotheses: DataFrame, ranked: DataFrame) -> DataFrame:
    """A row for each hypothesis: root cause, its posterior and all candidates in order; NULLs where there is none."""
    c = F.struct("rank", "stage_id", "posterior_probability")
    best = ranked.groupBy("hypothesis_id").agg(F.array_sort(F.collect_list(c)).alias("c"))
    top = F.get("c", 0)
    return hypotheses.join(best, "hypothesis_id", "left").select(
        "hypothesis_id", "triggered_at", top["stage_id"].alias("root_cause_stage_id"), top["posterior_probability"].alias("posterior_probability"),
        F.transform("c", lambda x: F.struct(x["stage_id"].alias("stage_id"), x["posterior_probability"].alias("posterior_probability"))).alias("ranked_candidates"), "evidence_count", "closed_at",
    )


def dominant_fault(ev: DataFrame) -> DataFrame:
    """(hypothesis_id, fault_type): the most frequent label; of equally frequent ones the one met first."""
    g = ev.filter("fault_label IS NOT NULL").groupBy("hypothesis_id", "fault_label").agg(F.count("*").alias("n"), F.min("detected_at").alias("t"))
    return g.groupBy("hypothesis_id").agg(F.min_by("fault_label", F.struct(-F.col("n"), F.col("t"), F.col("fault_label"))).alias("fault_type"))


def decide(found: DataFrame, faults: DataFrame, stages: DataFrame, rules: DataFrame) -> DataFrame:
    """The first matching rule of each localisation; without candidates the operator is paged."""
    known = F.broadcast(stages.select(F.col("stage_id").alias("root_cause_stage_id"), "stage_type"))
    case = found.join(faults, "hypothesis_id", "left").join(known, "root_cause_stage_id", "left").withColumn("severity", severity("posterior_probability"))
    r = F.broadcast(rules.select("rule_ord", "priority", "action", "description", *(F.col(c).alias(f"r_{c}") for c in ("fault_type", "severity", "stage_type"))))
    fits = None
    for c in ("fault_type", "severity", "stage_type"):
        one = F.col(f"r_{c}").isNull() | (F.col(f"r_{c}") == F.col(c))
        fits = one if fits is None else fits & one
    keys = ["hypothesis_id", "triggered_at", "root_cause_stage_id", "fault_type", "severity"]
    best = case.join(r, fits).groupBy(*keys).agg(F.min_by(F.struct("action", "description"), F.struct("priority", "rule_ord")).alias("r"))
    none = F.col("root_cause_stage_id").isNull()
    return best.select(
        "hypothesis_id", "triggered_at", F.coalesce("root_cause_stage_id", F.lit("unknown")).alias("target_stage_id"), F.when(~none, F.col("fault_type")).alias("fault_type"),
        F.when(none, "low").otherwise(F.col("severity")).alias("severity"), F.when(none, "page_operator").otherwise(F.col("r.action")).alias("action"),
        F.when(none, "fallback:no_candidates").otherwise(F.col("r.description")).alias("rule_matched"),
    )


class Correlator:
    """Open groups of related anomalies. A group is closed to what comes more than window_s after its first anomaly; an anomaly joins
    the oldest open group that its stage or an ancestor of it is in reach of, else it opens one."""

    def __init__(self, window_us: int, ancestors: dict[str, set[str]]):
        self.window_us, self.ancestors, self.open, self.opened = window_us, ancestors, [], 0

    def add(self, stage: str, us: int) -> int:
        """The number of the group that the anomaly belongs to; anomalies come in order of time."""
        self.open = [g for g in self.open if us - g[1] <= self.window_us]
        mine = {stage} | self.ancestors.get(stage, set())
        for n, _, reach in self.open:
            if mine & reach:
                reach |= mine
                return n
        self.opened += 1
        self.open.append((self.opened, us, mine))
        return self.opened


def reachable(stages: DataFrame) -> dict[str, set[str]]:
    """Each stage's ancestors, of a declared graph."""
    up: dict[str, set[str]] = {}
    for r in topology.closure(stages).select("descendant", "ancestor").collect():
        up.setdefault(r.descendant, set()).add(r.ancestor)
    return up


#: The order in which anomalies are met, and what an alert keeps of each.
MET = ("detected_at", "event_id", "metric", "detector_type", "signal")
PROOF = ("detected_at", "event_id", "metric", "detector_type", "signal", "stage_id", "detector_value", "z_score")


def alert_id(component: str, start: str, stages: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit("alert"), component, start, F.concat_ws(",", stages)).cast("binary"), 256), 1, 32)


def correlate(anomalies: DataFrame, stages: DataFrame, config: CorrelationConfig | None = None) -> DataFrame:
    """Alerts (alert_id, component_id, triggered_at, closed_at, affected_stage_ids, event_count, evidence in order of time). Stages
    of different parts of the graph never share a group, and a quiet time longer than the window closes all groups of a part: the
    pieces between are streamed through Correlator, which holds its open groups' reach only. Evidence is gathered by group after."""
    config = config or CorrelationConfig()
    up, width = reachable(stages), int(config.window_s * 1e6)
    parts = F.broadcast(topology.components(stages))  # the declared graph
    a = anomalies.join(parts, "stage_id", "left").withColumn("component_id", F.coalesce("component_id", "stage_id")).withColumn("t", F.unix_micros("detected_at"))
    cut = between_gaps(a.select("component_id", "t"), ["component_id"], width).select("component_id", "t", F.col("start").alias("piece"))
    rows = a.join(cut, ["component_id", "t"]).select("component_id", "piece", "t", *PROOF)
    dealt = rows.repartition("component_id", "piece").sortWithinPartitions("component_id", "piece", *MET)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "serial bigint"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c = None, None
        for b in batches:
            out = []
            for component, piece, stage, us in zip(*(b.column(n).to_pylist() for n in ("component_id", "piece", "stage_id", "t")), strict=True):
                if (component, piece) != key:
                    key, c = (component, piece), Correlator(width, up)
                out.append(c.add(stage, us))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "serial"])

    named = dealt.mapInArrow(fold, schema)
    found = named.groupBy("component_id", "piece", "serial").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.sort_array(F.collect_set("stage_id")).alias("affected_stage_ids"), F.count("*").alias("event_count"), F.sort_array(F.collect_list(F.struct(*PROOF))).alias("evidence"),
    ).filter(F.col("event_count") >= config.min_co_occurrence)
    return found.select(alert_id("component_id", "start", "affected_stage_ids").alias("alert_id"), "component_id", F.timestamp_micros("start").alias("triggered_at"), F.timestamp_micros("end").alias("closed_at"), "affected_stage_ids", "event_count", "evidence")
