"""The read surface: overview, paged metrics and anomalies, localisations, actions, and data for views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.metrics import error_flag, health
from driftline.operators.quantiles import exact_quantiles
from driftline.operators.tables import between, page


def overview(events: DataFrame, breakers: DataFrame) -> DataFrame:
    """Each stage's p99 latency (exact, see quantiles), event count, last event and breaker, as a registry has it."""
    s = events.groupBy("stage_id").agg(F.count("*").alias("event_count"), F.max("event_time").alias("last_event_at"))
    p = exact_quantiles(events, "stage_id", "latency_ms", {"p99": 0.99})
    both = s.join(p, s.stage_id.eqNullSafe(p.stage_id), "left").drop(p.stage_id)
    return both.join(breakers.select("stage_id", F.col("state").alias("breaker_state"), "trip_count"), "stage_id", "left").select(
        "stage_id", F.round(F.coalesce("p99", F.lit(0.0)), 3).alias("p99_ms"), "event_count", "last_event_at", F.coalesce("breaker_state", F.lit("unknown")).alias("breaker_state"), F.coalesce("trip_count", F.lit(0)).alias("trip_count")
    ).orderBy("stage_id")


def stage_metrics(events: DataFrame, stage_id: str, start: str | None = None, end: str | None = None, page_no: int = 1, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, newest first; a row with the total)."""
    rows = between(events, "event_time", start, end, stage_id=stage_id)
    total = rows.agg(F.count("*").alias("total"))
    cols = ["event_id", "stage_id", "event_time", "latency_ms", "row_count", "payload_bytes", "status", "fault_label"]
    return page(rows.select(*cols), [F.desc("event_time"), F.desc("event_id")], page_no, size), total


def stage_anomalies(anomalies: DataFrame, stage_id: str, detector_type: str | None = None, start: str | None = None, end: str | None = None, page_no: int = 1, size: int = 100) -> tuple[DataFrame, DataFrame]:
    rows = between(anomalies, "detected_at", start, end, stage_id=stage_id, detector_type=detector_type)
    return page(rows, [F.desc("detected_at"), F.desc("event_id"), F.asc("metric"), F.asc("detector_type"), F.asc("signal")], page_no, size), rows.agg(F.count("*").alias("total"))


def localization_page(found: DataFrame, page_no: int = 1, size: int = 50) -> DataFrame:
    return page(found, [F.desc("triggered_at"), F.asc("hypothesis_id")], page_no, size, 500)


def localization(found: DataFrame, hypothesis_id: str) -> DataFrame:
    """One localisation; LookupError if there is none."""
    one = found.filter(F.col("hypothesis_id") == hypothesis_id)
    if one.isEmpty():
        raise LookupError(hypothesis_id)
    return one


def action_page(actions: DataFrame, outcome: str | None = None, page_no: int = 1, size: int = 50) -> DataFrame:
    rows = actions.filter(F.col("outcome") == outcome) if outcome else actions
    return page(rows, [F.desc("triggered_at"), F.asc("id")], page_no, size, 500)


def health_grid(stages: DataFrame) -> DataFrame:
    label = F.create_map(*(F.lit(x) for kv in {"green": "healthy", "amber": "degraded", "red": "critical"}.items() for x in kv))
    return stages.withColumn("color", health()).withColumn("label", F.element_at(label, F.col("color")))


def graph_nodes(stages: DataFrame, overviews: DataFrame, localizations: DataFrame) -> DataFrame:
    """Nodes with a layered position and a state: the latest root cause and open breakers are red, slow stages amber."""
    last = localizations.filter("root_cause_stage_id IS NOT NULL").agg(F.max_by("root_cause_stage_id", F.struct("triggered_at", "hypothesis_id")).alias("root"))
    w = Window.orderBy("stage_id")  # the declared graph
    n = F.count("*").over(Window.partitionBy())
    j = stages.select("stage_id").join(overviews, "stage_id", "left").join(F.broadcast(last))
    color = F.when(F.col("stage_id") == F.col("root"), "red").when(F.col("breaker_state") == "open", "red").when(F.col("p99_ms") >= 100, "amber").otherwise("green")
    return j.select("stage_id", color.alias("color"), ((F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1))).alias("x"), F.lit(0.5).alias("y"))


def timeline(anomalies: DataFrame, bucket: str = "day") -> DataFrame:
    t = F.date_trunc(bucket, "detected_at")
    return anomalies.groupBy(t.alias("bucket"), "stage_id", "detector_type").agg(F.count("*").alias("anomalies"), F.max(F.abs("z_score")).alias("max_abs_z"))


def audit_trail(actions: DataFrame, localizations: DataFrame) -> DataFrame:
    return actions.join(localizations.select("hypothesis_id", "root_cause_stage_id", "posterior_probability"), "hypothesis_id", "left")


def latency_histogram(events: DataFrame, edges: tuple[float, ...] = (5, 10, 25, 50, 75, 100, 250, 500)) -> DataFrame:
    """Cumulative buckets: events at or below each edge, the last being all."""
    wide = events.groupBy("stage_id").agg(*(F.count(F.when(F.col("latency_ms") <= e, 1)).alias(f"le_{e:g}") for e in edges), F.count("*").alias("le_inf"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{e:g}").alias("le"), F.col(f"le_{e:g}").alias("n")) for e in edges), F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n"))))
    return wide.select("stage_id", pairs.alias("p")).select("stage_id", "p.le", "p.n")


def consumer_lag(events: DataFrame, now) -> DataFrame:
    """Rows, the oldest event and its lag for each stage."""
    oldest = F.min("event_time")
    return events.groupBy("stage_id").agg(F.count("*").alias("rows"), oldest.alias("oldest"), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(oldest)) / 1e6).alias("lag_s"))


def error_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("stage_id", "status").agg(F.count("*").alias("n"), F.avg(error_flag()).alias("error_rate"))


def health_report(events: DataFrame, stages: DataFrame, breakers: DataFrame, now: Column, most_lag_s: float = 86_400.0) -> DataFrame:
    """(component, ok, detail) for the metrics table, each declared stage (has it reported within most_lag_s of now?) and each
    breaker that isn't closed."""
    seen = events.groupBy("stage_id").agg(F.count("*").alias("n"), F.max("event_time").alias("last"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    table = total.select(F.lit("metrics").alias("component"), (F.col("n") > 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))
    lag = F.floor((F.unix_micros(now) - F.unix_micros("last")) / 1e6)
    stage = stages.select("stage_id").join(seen, "stage_id", "left").select(F.concat(F.lit("stage:"), "stage_id"), F.coalesce(lag <= most_lag_s, F.lit(False)), F.coalesce(F.concat(lag.cast("string"), F.lit(" s behind")), F.lit("never seen")))
    broken = breakers.filter("state <> 'closed'").select(F.concat(F.lit("breaker:"), "stage_id"), F.lit(False), F.concat("state", F.lit(", trips "), F.col("trip_count").cast("string")))
    return table.union(stage).union(broken)
