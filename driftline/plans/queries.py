"""The engine's queries over the stand-in events, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import config
from driftline.functions import metrics, wire
from driftline.operators import baseline, charts, folds, incidents, reads, registry, tables, topology, windows
from driftline.operators.snapshots import Versions, fingerprint
from driftline.operators.stored import shared_folder
from driftline.plans import oracles as o
from driftline.sources import simulator
from driftline.sources.events import pipeline_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BREAKER = config.BreakerConfig(2, 60.0, 3600.0, 2.0)
GAP = config.CollectorConfig(900.0, 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def us(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c)


def scored(s: SparkSession, d: str, seasonal: bool = False) -> DataFrame:
    e = pipeline_events(s, d)
    return baseline.z_scores(e, tables.kept(baseline.fit(e, baseline.latest(e), seasonal=seasonal), "baselines"))


MADE: dict[tuple, dict[str, DataFrame]] = {}


def made(s: SparkSession, d: str, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables that several queries read, written once for a session and a state of the events."""
    key = (s.sparkContext.applicationId, d, name, *fingerprint(pipeline_events(s, d), "event_time"))
    if key not in MADE:
        MADE[key] = make()
    return MADE[key]


def anomalies(s: SparkSession, d: str) -> DataFrame:
    found = lambda: {"a": tables.kept(charts.detect(scored(s, d), config.CusumConfig(), config.EwmaConfig()), "anomalies")}
    return made(s, d, "anomalies", found)["a"]


def incident(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The closed loop: anomalies, hypotheses and evidence are tables, as detectors and collectors write them; what is ranked
    and decided from them is lazy."""

    def make() -> dict[str, DataFrame]:
        a, st = anomalies(s, d), config.stages(s)
        h = tables.kept(incidents.sessions(a, GAP), "hypotheses")
        ev = tables.kept(incidents.evidence(a, h), "evidence")
        ranked = incidents.localize(ev, st)
        found = incidents.localizations(h, ranked)
        decisions = incidents.decide(found, incidents.dominant_fault(ev), st, config.rules(s))
        return {"anomalies": a, "hypotheses": h, "evidence": ev, "ranked": ranked, "found": found, "decisions": decisions, "actions": tables.record(decisions)}

    return made(s, d, "incident", make)


def breakers_now(s: SparkSession, d: str) -> DataFrame:
    """The breakers as the registry has them, advanced over the events in two runs."""

    def make() -> dict[str, DataFrame]:
        e = pipeline_events(s, d).withColumn("ok", F.col("status") == "ok")
        book = registry.BreakerRegistry(s, f"{shared_folder(s)}/breakers-{uuid.uuid4().hex}", BREAKER)
        book.advance(e.filter("event_time < TIMESTAMP '2024-01-15'"))
        book.advance(e)
        return {"b": book.load()}

    return made(s, d, "breakers", make)["b"]


def shown(a: DataFrame) -> DataFrame:
    return a.select("detector_type", "stage_id", "metric", "signal", r6("detector_value"), r6("threshold"), r6("z_score"), us("detected_at"), "fault_label", "event_id")


ANOMALY_SQL = "detector_type, stage_id, metric, signal, round(detector_value, 6) AS detector_value, round(threshold, 6) AS threshold, round(z_score, 6) AS z_score, epoch_us(detected_at) AS detected_at, fault_label, event_id"


@query(o.q(o.EV, "SELECT event_id, stage_id, epoch_us(event_time) AS event_time, latency_ms, row_count, payload_bytes, status, fault_label, trace_id FROM ev"))
def src10_pipeline_events(s, d):
    return pipeline_events(s, d).withColumn("event_time", F.unix_micros("event_time"))


@query(o.q(o.EV, "SELECT event_id, stage_id, latency_ms FROM ev WHERE event_id = 77"))
def src11_event_by_key(s, d):
    return pipeline_events(s, d).filter("event_id = 77").select("event_id", "stage_id", "latency_ms")


def market(s: SparkSession, d: str, trade: bool = True) -> DataFrame:
    """A stage graph from the given tables: regions feed nations, nations suppliers, and suppliers (trade) and nations customers."""
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    row = lambda i, kind, up, delay: (i.alias("stage_id"), F.lit(kind).alias("stage_type"), up.alias("upstream_ids"), delay.cast("double").alias("propagation_delay_ms"))
    none = F.array().cast("array<string>")
    out = t("region").select(*row(name("r", "r_regionkey"), "source", none, F.lit(0)))
    out = out.union(t("nation").select(*row(name("n", "n_nationkey"), "transform", F.array(name("r", "n_regionkey")), F.col("n_nationkey"))))
    if trade:
        out = out.union(t("supplier").select(*row(name("s", "s_suppkey"), "transform", F.array(name("n", "s_nationkey")), F.col("s_suppkey") % 50)))
        bought = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), "l_suppkey").repartition("c").distinct()
        met = bought.groupBy("c").agg(F.array_sort(F.collect_list(name("s", "l_suppkey"))).alias("up"))
        c = t("customer").join(met, F.col("c_custkey") == F.col("c"), "left")
        up = F.concat(F.array(name("n", "c_nationkey")), F.coalesce("up", none))
    else:
        c, up = t("customer"), F.array(name("n", "c_nationkey"))
    return out.union(c.select(*row(name("c", "c_custkey"), "sink", up, F.col("c_custkey") % 100)))


@query(o.q(o.MARKET, "SELECT src, dst, delay_ms FROM ed"))
def src6_topology_edges(s, d):
    return topology.edges(market(s, d))


@query("""SELECT row_number() OVER (ORDER BY priority, severity NULLS FIRST) - 1 AS rule_ord, priority, NULL::VARCHAR AS fault_type, severity, NULL::VARCHAR AS stage_type, action FROM (SELECT DISTINCT left(o_orderpriority, 1)::BIGINT * 10 AS priority,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN o_orderpriority LIKE '1%' THEN 'circuit_break' WHEN o_orderpriority LIKE '2%' THEN 'reroute_traffic' ELSE 'rate_limit' END AS action FROM orders
  UNION ALL SELECT 999, NULL, 'page_operator')""")
def src7_policy_rules(s, d):
    """A policy from the orders' priorities, with a last rule for the rest."""
    p = F.col("o_orderpriority")
    rows = s.read.parquet(f"{d}/orders.parquet").select(p).distinct().select(
        (F.left(p, F.lit(1)).cast("bigint") * 10).alias("priority"), F.when(p.rlike("^[12]"), "high").when(p.startswith("3"), "medium").otherwise("low").alias("severity"),
        F.when(p.startswith("1"), "circuit_break").when(p.startswith("2"), "reroute_traffic").otherwise("rate_limit").alias("action"),
    )
    found = sorted({(r.priority, None, r.severity, None, r.action) for r in rows.collect()}, key=lambda r: (r[0], r[2]))  # a policy's few rules
    return config.rules(s, [*found, (999, None, None, None, "page_operator")]).select(F.col("rule_ord").cast("bigint").alias("rule_ord"), F.col("priority").cast("bigint").alias("priority"), "fault_type", "severity", "stage_type", "action")


LOG = o.EV + ", lg AS (SELECT *, (event_id % 4)::INT AS partition, event_id // 4 AS \"offset\" FROM ev)"


def message_log(s: SparkSession, d: str) -> DataFrame:
    return pipeline_events(s, d).withColumn("partition", (F.col("event_id") % 4).cast("int")).withColumn("offset", F.floor(F.col("event_id") / 4))


@query(o.q(LOG, 'SELECT event_id, stage_id, partition, "offset", true AS replayed FROM lg WHERE partition = 1 AND "offset" BETWEEN 10 AND 150'))
def src9_offset_range_replay(s, d):
    return tables.replay(message_log(s, d), 1, 10, 150).select("event_id", "stage_id", "partition", "offset", "replayed")


ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
BODY = "'{\"schema_version\":' || {v} || ',\"stage_id\":\"' || stage_id || '\",\"event_time\":\"' || " + ISO.format(t="event_time") + " || '\",\"latency_ms\":' || latency_ms::VARCHAR || ',\"row_count\":' || row_count || ',\"payload_bytes\":' || payload_bytes || ',\"status\":\"' || status || '\",\"fault_label\":' || coalesce('\"' || fault_label || '\"', 'null') || ',\"trace_id\":\"' || trace_id || '\"}'"


@query(o.q(o.EV, f"SELECT event_id, {BODY.replace('{v}', '1')} AS value FROM ev"))
def ser1_event_json(s, d):
    return pipeline_events(s, d).select("event_id", wire.encode().alias("value"))


def messages(s: SparkSession, d: str) -> DataFrame:
    """The log as wire messages, some of them broken in a way that event_id tells."""
    m = message_log(s, d).withColumn("value", wire.encode())
    k = F.col("event_id") % 11
    broken = (
        F.when(k == 1, F.lit("torn [1, 2")).when(k == 2, F.regexp_replace("value", '"schema_version":1', '"schema_version":9'))
        .when(k == 3, F.regexp_replace("value", '"status":"[a-z]*",', "")).when(k == 4, F.regexp_replace("value", '"row_count":[0-9]+', '"row_count":"many"')).otherwise(F.col("value"))
    )
    return m.select("event_id", "partition", "offset", broken.alias("value"))


ERROR = "CASE event_id % 11 WHEN 1 THEN 'invalid json' WHEN 2 THEN 'unsupported schema_version' WHEN 3 THEN 'missing field: status' WHEN 4 THEN 'invalid field: row_count' END"


@query(o.q(o.EV, f"""SELECT event_id, error, CASE WHEN error IS NULL THEN stage_id END AS stage_id, CASE WHEN error IS NULL THEN epoch_us(event_time) ELSE -1 END AS event_time, CASE WHEN error IS NULL THEN latency_ms END AS latency_ms,
  CASE WHEN error IS NULL THEN row_count ELSE -1 END AS row_count, CASE WHEN error IS NULL THEN payload_bytes ELSE -1 END AS payload_bytes, CASE WHEN error IS NULL THEN status END AS status, CASE WHEN error IS NULL THEN fault_label END AS fault_label, CASE WHEN error IS NULL THEN trace_id END AS trace_id
  FROM (SELECT *, {ERROR} AS error FROM ev)"""))
def ser2_decoded_messages(s, d):
    out = wire.decode(messages(s, d)).drop("partition", "offset", "value")
    return out.withColumn("event_time", F.unix_micros("event_time")).fillna(-1, ["event_time", "row_count", "payload_bytes"])


@query(o.q(LOG, f"""SELECT 'pipeline.metrics.dlq' AS topic, '{{"source_topic":"pipeline.metrics","source_partition":' || partition || ',"source_offset":' || "offset" || ',"error":"' || ({ERROR}) || '","received_at":"2024-02-01T00:00:00.000000+00:00","raw_payload":"torn [1, 2"}}' AS value FROM lg WHERE event_id % 11 = 1"""))
def snk6_dead_letters(s, d):
    bad = wire.decode(messages(s, d)).filter("error = 'invalid json'")
    return wire.dead_letter(bad, "pipeline.metrics", received_at=F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query(o.q(o.EV, "SELECT event_id, " + ISO.format(t="event_time") + " AS at FROM ev"))
def ser6_iso_times(s, d):
    return pipeline_events(s, d).select("event_id", metrics.iso("event_time").alias("at"))


@query(o.q(o.EV + ", " + o.LONG, "SELECT event_id, stage_id, metric, value FROM lm"))
def pf1_metrics_long(s, d):
    return metrics.long_metrics(pipeline_events(s, d)).select("event_id", "stage_id", "metric", "value")


def _slots(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "metric", r6("baseline_mean"), r6("baseline_std"), "sample_count")


SLOT_SQL = "metric, round(baseline_mean, 6) AS baseline_mean, round(baseline_std, 6) AS baseline_std, sample_count FROM base"


@query(o.q(", ".join((o.EV, o.LONG, o.base(True))), f"SELECT stage_id, hour_of_week, {SLOT_SQL}"))
def a1_seasonal_baselines(s, d):
    e = pipeline_events(s, d)
    return _slots(baseline.fit(e, baseline.latest(e)), "stage_id", "hour_of_week")


@query(o.q(", ".join((o.EV, o.LONG, o.base(False))), f"SELECT stage_id, {SLOT_SQL}"))
def a1_stage_baselines(s, d):
    e = pipeline_events(s, d)
    return _slots(baseline.fit(e, baseline.latest(e), seasonal=False), "stage_id")


@query(o.q(o.FULL, "SELECT detector_type, stage_id, metric, signal, round(detector_value, 6) AS detector_value, round(z_score, 6) AS z_score, epoch_us(detected_at) AS detected_at, fault_label, NULL::VARCHAR AS error FROM an"))
def ser4_decoded_anomalies(s, d):
    """Anomalies through their wire format and back (SER3, SER4)."""
    back = wire.decode(anomalies(s, d).select(wire.encode("anomaly").alias("value")), kind="anomaly")
    return back.select("detector_type", "stage_id", "metric", "signal", r6("detector_value"), r6("z_score"), us("detected_at"), "fault_label", "error")


@query(o.q(", ".join((o.EV, o.LONG, o.base(True))), f"""SELECT stage_id, hour_of_week, metric, round(CASE WHEN hour_of_week < 84 THEN baseline_mean + 1 ELSE baseline_mean END, 6) AS baseline_mean, round(baseline_std, 6) AS baseline_std, sample_count FROM base"""))
def snk8_baseline_upsert(s, d):
    e = pipeline_events(s, d)
    old = baseline.fit(e, baseline.latest(e)).withColumn("fitted_at", F.lit("2024-01-30 00:00:00").cast("timestamp"))
    new = old.filter("hour_of_week < 84").withColumn("baseline_mean", F.col("baseline_mean") + 1).withColumn("fitted_at", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    table = Versions(s, f"{shared_folder(s)}/baselines-{uuid.uuid4().hex}")
    for fitted in (old, new):
        table.upsert(fitted, (*baseline.SLOT, "metric"), "fitted_at")
    return _slots(table.read(), "stage_id", "hour_of_week")


@query(o.q(", ".join((o.EV, o.LONG, o.base(True), o.z(True))), "SELECT event_id, metric, round(z, 6) AS z FROM z"))
def j1_seasonal_z_scores(s, d):
    return scored(s, d, True).select("event_id", "metric", r6("z"))


@query(o.q(", ".join((o.EV, o.LONG, o.base(True))), """, v AS (SELECT stage_id, hour_of_week, metric, baseline_mean AS m, baseline_std AS sd, TIMESTAMP '2024-01-01' AS f FROM base UNION ALL SELECT stage_id, hour_of_week, metric, baseline_mean + 1, baseline_std * 2, TIMESTAMP '2024-01-12' FROM base WHERE hour_of_week < 84)
SELECT event_id, lm.metric, round(CASE WHEN sd <> 0 THEN (value - m) / sd END, 6) AS z FROM lm ASOF LEFT JOIN v ON lm.stage_id = v.stage_id AND lm.hour_of_week = v.hour_of_week AND lm.metric = v.metric AND lm.event_time >= v.f"""))
def j1_scores_as_of_fit(s, d):
    """Scores by the fit that was newest at each event's time, across a refit of half the slots."""
    e = pipeline_events(s, d)
    old = tables.kept(baseline.fit(e, baseline.latest(e)), "baselines").withColumn("fitted_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    new = old.filter("hour_of_week < 84").withColumn("baseline_mean", F.col("baseline_mean") + 1).withColumn("baseline_std", F.col("baseline_std") * 2).withColumn("fitted_at", F.lit("2024-01-12 00:00:00").cast("timestamp"))
    return baseline.z_scores_as_of(e, old.unionByName(new)).select("event_id", "metric", r6("z"))


def _window(df: DataFrame) -> DataFrame:
    return df.select("event_id", "stage_id", F.col("sample_count").cast("bigint").alias("sample_count"), "is_stable", *(r6(c) for c in windows.STATS))


@query(o.q(o.EV + ", " + o.window(3600, 5), "SELECT * FROM ws"))
def w1_sliding_statistics(s, d):
    return _window(windows.at_events(pipeline_events(s, d), config.WindowConfig(3600.0, 1.0, 5, 1000)))


@query(o.q(o.EV, """, c AS (SELECT a.event_id, a.stage_id, b.latency_ms, b.row_count, b.err, row_number() OVER (PARTITION BY a.event_id ORDER BY b.event_time DESC, b.event_id DESC) AS r
  FROM ev a JOIN ev b ON a.stage_id = b.stage_id AND b.event_time <= a.event_time AND b.event_time >= a.event_time - INTERVAL 7200 SECOND),
g AS (SELECT event_id, stage_id, count(*) AS n, quantile_cont(latency_ms, 0.5) AS a, quantile_cont(latency_ms, 0.95) AS b, quantile_cont(latency_ms, 0.99) AS c, avg(latency_ms) AS d, avg(row_count) AS e, avg(err) AS f FROM c WHERE r <= 6 GROUP BY 1, 2)
SELECT event_id, stage_id, n::BIGINT AS sample_count, n >= 3 AS is_stable, CASE WHEN n >= 3 THEN round(a, 6) END AS p50_latency_ms, CASE WHEN n >= 3 THEN round(b, 6) END AS p95_latency_ms, CASE WHEN n >= 3 THEN round(c, 6) END AS p99_latency_ms,
  CASE WHEN n >= 3 THEN round(d, 6) END AS mean_latency_ms, CASE WHEN n >= 3 THEN round(e, 6) END AS mean_row_count, CASE WHEN n >= 3 THEN round(f, 6) END AS error_rate FROM g"""))
def st6_capped_window(s, d):
    return _window(windows.at_events(pipeline_events(s, d), config.WindowConfig(7200.0, 1.0, 3, 6), capped=True))


@query(o.q(o.EV, """, t AS (SELECT *, unnest(range(CAST(ceil(epoch_us(event_time) / 600e6) AS BIGINT), CAST(floor((epoch_us(event_time) + 1800000000) / 600e6) AS BIGINT) + 1)) AS k FROM ev),
g AS (SELECT stage_id, k * 600000000 AS tick, count(*) AS n, quantile_cont(latency_ms, 0.5) AS a, quantile_cont(latency_ms, 0.95) AS b, quantile_cont(latency_ms, 0.99) AS c, avg(latency_ms) AS m, avg(row_count) AS r, avg(err) AS e FROM t GROUP BY 1, 2)
SELECT stage_id, tick, n AS sample_count, n >= 5 AS is_stable, CASE WHEN n >= 5 THEN round(a, 6) END AS p50_latency_ms, CASE WHEN n >= 5 THEN round(b, 6) END AS p95_latency_ms, CASE WHEN n >= 5 THEN round(c, 6) END AS p99_latency_ms,
  CASE WHEN n >= 5 THEN round(m, 6) END AS mean_latency_ms, CASE WHEN n >= 5 THEN round(r, 6) END AS mean_row_count, CASE WHEN n >= 5 THEN round(e, 6) END AS error_rate FROM g"""))
def w2_tick_statistics(s, d):
    out = windows.at_ticks(pipeline_events(s, d), 600, config.WindowConfig(1800.0, 600.0, 5, 1000))
    return out.select("stage_id", us("tick"), "sample_count", "is_stable", *(r6(c) for c in windows.STATS))


@query(o.q(o.EV, "SELECT stage_id, epoch_us(time_bucket(INTERVAL 3600 SECOND, event_time)) AS window_start, count(*) AS sample_count, round(avg(latency_ms), 6) AS mean_latency_ms, max(latency_ms) AS max_latency_ms, sum(row_count)::BIGINT AS rows, round(avg(err), 6) AS error_rate FROM ev GROUP BY 1, 2"))
def st10_metrics_downsampled(s, d):
    return windows.downsampled(pipeline_events(s, d), 3600).select("stage_id", us("window_start"), "sample_count", r6("mean_latency_ms"), "max_latency_ms", "rows", r6("error_rate"))


@query(o.q(o.DETECT, f"SELECT {ANOMALY_SQL} FROM ca"))
def st1_cusum(s, d):
    return shown(folds.cusum(scored(s, d)))


@query(o.q(", ".join((o.EV, o.LONG, o.base(True), o.z(True), o.ORDERED, o.CUSUM)), f"SELECT {ANOMALY_SQL} FROM ca"))
def st1_cusum_seasonal(s, d):
    return shown(folds.cusum(scored(s, d, True)))


@query(o.q(o.DETECT, f"SELECT {ANOMALY_SQL} FROM ea"))
def st2_ewma(s, d):
    return shown(folds.ewma(scored(s, d)))


@query(o.q(", ".join((o.EV, o.LONG, o.base(True), o.z(True), o.ORDERED, o.EWMA)), f"SELECT {ANOMALY_SQL} FROM ea"))
def st2_ewma_seasonal(s, d):
    return shown(folds.ewma(scored(s, d, True)))


@query(o.q(o.DETECT, f"SELECT {ANOMALY_SQL} FROM an"))
def u1_all_anomalies(s, d):
    return shown(anomalies(s, d))


def breaker_history(s: SparkSession, d: str) -> DataFrame:
    return folds.breakers(pipeline_events(s, d).withColumn("ok", F.col("status") == "ok"), BREAKER)


@query(o.q(o.EV + ", " + o.BREAKER, "SELECT stage_id, event_id, state, fails AS failure_count, trips AS trip_count, coalesce(opened, -1) AS opened_us FROM br"))
def st3_breaker_states(s, d):
    return breaker_history(s, d).select("stage_id", "event_id", "state", "failure_count", "trip_count", "opened_us").fillna(-1, ["opened_us"])


@query(o.q(", ".join((o.EV, o.BREAKER, o.LAST)), "SELECT stage_id, state, failure_count, trip_count FROM lb"))
def st8_breaker_snapshot(s, d):
    return breakers_now(s, d).select("stage_id", "state", "failure_count", "trip_count")


@query(o.q(", ".join((o.EV, o.BREAKER, o.LAST, o.OVERVIEW)), "SELECT stage_id, p99_ms, event_count, epoch_us(last_event_at) AS last_event_at, coalesce(state, 'unknown') AS breaker_state, coalesce(trip_count, 0) AS trip_count FROM ov LEFT JOIN lb USING (stage_id)"))
def q1_stages_overview(s, d):
    return reads.overview(pipeline_events(s, d), breakers_now(s, d)).withColumn("last_event_at", F.unix_micros("last_event_at"))


RANGE = "stage_id = 'transform_validate' AND event_time >= TIMESTAMP '2024-01-03' AND event_time < TIMESTAMP '2024-01-20'"


@query(o.q(o.EV, f"SELECT event_id, stage_id, epoch_us(event_time) AS event_time, latency_ms, row_count, payload_bytes, status, fault_label FROM ev WHERE {RANGE} ORDER BY ev.event_time DESC, event_id DESC LIMIT 50 OFFSET 50"))
def q2_stage_metrics_page(s, d):
    rows, _ = reads.stage_metrics(pipeline_events(s, d), "transform_validate", "2024-01-03", "2024-01-20", 2, 50)
    return rows.withColumn("event_time", F.unix_micros("event_time"))


@query(o.q(o.EV, f"SELECT count(*) AS total FROM ev WHERE {RANGE}"))
def a4_stage_metrics_total(s, d):
    return reads.stage_metrics(pipeline_events(s, d), "transform_validate", "2024-01-03", "2024-01-20", 2, 50)[1]


@query(o.q(o.DETECT, f"SELECT {ANOMALY_SQL} FROM an WHERE stage_id = 'source_kafka' AND detector_type = 'ewma' ORDER BY an.detected_at DESC, event_id DESC, metric, detector_type, signal LIMIT 20"))
def q3_stage_anomalies_page(s, d):
    return shown(reads.stage_anomalies(anomalies(s, d), "source_kafka", "ewma", None, None, 1, 20)[0])


@query(o.q(o.FULL, "SELECT hypothesis_id, epoch_us(triggered_at) AS triggered_at, epoch_us(closed_at) AS closed_at, evidence_count FROM hy"))
def st4_hypotheses(s, d):
    return incident(s, d)["hypotheses"].select("hypothesis_id", us("triggered_at"), us("closed_at"), "evidence_count")


@query(o.q(o.FULL + ", " + o.ALERTS, """SELECT substring(sha256('alert:sink_warehouse:' || min(t)::VARCHAR || ':' || array_to_string(list_sort(list_distinct(list(stage_id))), ',')), 1, 32) AS alert_id, 'sink_warehouse' AS component_id, min(t) AS triggered_at, max(t) AS closed_at,
  array_to_string(list_sort(list_distinct(list(stage_id))), ',') AS affected, count(*) AS event_count, string_agg(event_id || ':' || metric || ':' || detector_type || ':' || signal, ',' ORDER BY n) AS evidence FROM placed JOIN na USING (n) GROUP BY serial HAVING count(*) >= 2"""))
def st5_correlated_alerts(s, d):
    a = incidents.correlate(anomalies(s, d), config.stages(s), config.CorrelationConfig(900.0, 2))
    proof = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["metric"], x["detector_type"], x["signal"])), ",")
    return a.select("alert_id", "component_id", us("triggered_at"), us("closed_at"), F.array_join("affected_stage_ids", ",").alias("affected"), "event_count", proof.alias("evidence"))


@query(o.q(o.FULL, "SELECT hypothesis_id, candidate, round(score, 6) AS score FROM sc"))
def l2_candidate_scores(s, d):
    return incidents.scores(incident(s, d)["evidence"], config.stages(s)).select("hypothesis_id", "candidate", r6("score"))


@query(o.q(o.FULL, "SELECT hypothesis_id, candidate AS stage_id, round(score, 6) AS score, round(p, 6) AS posterior_probability, rank FROM rk"))
def l4_root_cause_ranking(s, d):
    return incident(s, d)["ranked"].select("hypothesis_id", "stage_id", r6("score"), r6("posterior_probability"), F.col("rank").cast("bigint").alias("rank"))


@query(o.q(o.FULL, "SELECT hypothesis_id, fault_type FROM df"))
def a7_dominant_fault(s, d):
    return incidents.dominant_fault(incident(s, d)["evidence"])


DECISION = "hypothesis_id, epoch_us(triggered_at) AS triggered_at, target_stage_id, fault_type, severity, action, rule_matched"


@query(o.q(o.FULL, f"SELECT {DECISION} FROM de"))
def h1_healing_decisions(s, d):
    return incident(s, d)["decisions"].withColumn("triggered_at", F.unix_micros("triggered_at"))


FOUND = "hypothesis_id, epoch_us(triggered_at) AS triggered_at, candidate AS root_cause_stage_id, round(p, 6) AS posterior_probability, evidence_count"


def _found(df: DataFrame) -> DataFrame:
    return df.select("hypothesis_id", us("triggered_at"), "root_cause_stage_id", r6("posterior_probability"), "evidence_count")


@query(o.q(o.FULL, f"SELECT {FOUND} FROM hy JOIN rk USING (hypothesis_id) WHERE rank = 1 ORDER BY hy.triggered_at DESC, hypothesis_id LIMIT 50"))
def q4_localizations_page(s, d):
    return _found(reads.localization_page(incident(s, d)["found"]))


@query(o.q(o.FULL, "SELECT hypothesis_id, string_agg(candidate || '=' || printf('%.4f', p), ',' ORDER BY rank) AS ranked FROM rk WHERE hypothesis_id = (SELECT hypothesis_id FROM hy ORDER BY evidence_count DESC, hypothesis_id LIMIT 1) GROUP BY 1"))
def q5_localization_detail(s, d):
    found = incident(s, d)["found"]
    top = found.agg(F.min_by("hypothesis_id", F.struct(-F.col("evidence_count"), F.col("hypothesis_id"))).alias("hypothesis_id")).first().hypothesis_id
    one = reads.localization(found, top) if top else found
    return one.select("hypothesis_id", F.array_join(F.transform("ranked_candidates", lambda x: F.format_string("%s=%.4f", x["stage_id"], x["posterior_probability"])), ",").alias("ranked"))


@query(o.q(o.FULL, "SELECT hypothesis_id, candidate AS stage_id, round(p, 6) AS posterior_probability, rank FROM rk"))
def ser5_ranked_json(s, d):
    """Ranked candidates through their JSON and back."""
    told = incident(s, d)["found"].select("hypothesis_id", wire.listed("ranked_candidates").alias("json"))
    back = told.select("hypothesis_id", F.posexplode(wire.ranked("json")).alias("k", "c"))
    return back.select("hypothesis_id", "c.stage_id", F.round("c.posterior_probability", 6).alias("posterior_probability"), (F.col("k") + 1).cast("bigint").alias("rank"))


@query(o.q(o.FULL, "SELECT hypothesis_id, row_number() OVER (PARTITION BY hypothesis_id ORDER BY detected_at, event_id, metric, detector_type, signal) AS n, epoch_us(detected_at) AS detected_at, event_id, stage_id, metric, detector_type, signal, round(z_score, 6) AS z_score FROM evd"))
def ser5_evidence_json(s, d):
    """Each hypothesis' evidence, in order of time, through its JSON and back."""
    told = incidents.evidence_lists(incident(s, d)["evidence"]).select("hypothesis_id", wire.listed("evidence").alias("json"))
    back = told.select("hypothesis_id", F.posexplode(wire.evidence("json")).alias("k", "e"))
    return back.select("hypothesis_id", (F.col("k") + 1).cast("bigint").alias("n"), F.unix_micros("e.detected_at").alias("detected_at"), "e.event_id", "e.stage_id", "e.metric", "e.detector_type", "e.signal", F.round("e.z_score", 6).alias("z_score"))


ACTION_SQL = "id, hypothesis_id, target_stage_id AS stage_id, action, fault_type, severity, 'pending' AS outcome, epoch_us(triggered_at) AS triggered_at"


@query(o.q(o.FULL, f"SELECT {ACTION_SQL} FROM ac ORDER BY ac.triggered_at DESC, id LIMIT 50"))
def q6_actions_page(s, d):
    rows = reads.action_page(tables.current_actions(incident(s, d)["actions"]), "pending")
    return rows.select("id", "hypothesis_id", "stage_id", "action", "fault_type", "severity", "outcome", us("triggered_at"))


def resolved_log(s: SparkSession, d: str) -> DataFrame:
    """Actions with the resolutions of those whose severity is medium appended."""
    log = incident(s, d)["actions"]
    done = log.filter("severity = 'medium'").select("id", F.lit("success").alias("outcome"), (F.col("triggered_at") + F.expr("INTERVAL 60 SECOND")).alias("resolved_at"), F.lit("done").alias("notes"))
    return log.unionByName(tables.resolve(log, done))


@query(o.q(o.FULL, "SELECT id, hypothesis_id, CASE WHEN severity = 'medium' THEN 'success' ELSE 'pending' END AS outcome, CASE WHEN severity = 'medium' THEN epoch_us(triggered_at) + 60000000 ELSE -1 END AS resolved_at FROM ac"))
def snk11_resolved_actions(s, d):
    return tables.current_actions(resolved_log(s, d)).select("id", "hypothesis_id", "outcome", us("resolved_at")).fillna(-1, ["resolved_at"])


@query(o.q(o.FULL, "SELECT hypothesis_id, target_stage_id AS stage_id, action, 'pending' AS outcome FROM de UNION ALL SELECT hypothesis_id, target_stage_id, action, 'success' FROM de WHERE severity = 'medium'"))
def h3_audit_by_hypothesis(s, d):
    """The audit log's rows of every hypothesis, each one's oldest first."""
    return tables.audit(resolved_log(s, d)).select("hypothesis_id", "stage_id", "action", "outcome")


@query(o.q(o.FULL, "SELECT hypothesis_id, 'unknown' AS target_stage_id, NULL::VARCHAR AS fault_type, 'low' AS severity, 'page_operator' AS action, 'fallback:no_candidates' AS rule_matched FROM hy"))
def h2_no_candidates(s, d):
    """Decisions on hypotheses whose evidence names no stage of the graph."""
    i = incident(s, d)
    other = config.stages(s, [("elsewhere", "source", [], 0.0), ("nowhere", "sink", ["elsewhere"], 1.0)])
    found = incidents.localizations(i["hypotheses"], incidents.localize(i["evidence"], other))
    return incidents.decide(found, incidents.dominant_fault(i["evidence"]), other, config.rules(s)).select("hypothesis_id", "target_stage_id", "fault_type", "severity", "action", "rule_matched")


@query(o.q(o.FULL, "SELECT hypothesis_id, 'cancelled' AS outcome, 'override: operator' AS notes FROM ac WHERE severity <> 'medium' ORDER BY triggered_at DESC, id DESC LIMIT 1"))
def q7_override_newest(s, d):
    log = resolved_log(s, d)
    newest = tables.current_actions(log).filter("outcome = 'pending'").orderBy(F.desc("triggered_at"), F.desc("id")).select("hypothesis_id").first()
    table = Versions(s, f"{shared_folder(s)}/actions-{uuid.uuid4().hex}")
    table.update(lambda _: log)
    if newest:  # checked on the newest version, and again if another writer comes first
        table.append(lambda known: tables.override(known, newest.hypothesis_id, F.current_timestamp(), "operator"))
    return table.read().filter("outcome = 'cancelled'").select("hypothesis_id", "outcome", "notes")


@query(o.q(o.FULL, f"SELECT {FOUND} FROM hy JOIN rk USING (hypothesis_id) WHERE rank = 1 AND evidence_count > 1"))
def snk9_new_localizations(s, d):
    found = incident(s, d)["found"]
    table = Versions(s, f"{shared_folder(s)}/localizations-{uuid.uuid4().hex}")
    known = table.insert_new(found.filter("evidence_count <= 1"), "hypothesis_id")
    for _ in range(2):  # the second time there is nothing new
        table.insert_new(found, "hypothesis_id")
    return _found(table.read().join(table.read(known).select("hypothesis_id"), "hypothesis_id", "left_anti"))


@query(o.q(o.FULL, "SELECT id, hypothesis_id, target_stage_id AS root_cause_stage_id, round(p, 6) AS posterior_probability FROM ac"))
def j9_audit_trail(s, d):
    i = incident(s, d)
    return reads.audit_trail(i["actions"], i["found"]).select("id", "hypothesis_id", "root_cause_stage_id", r6("posterior_probability"))


CLOSURE = ", ".join((o.MARKET, o.MARKET_WALK))


@query(o.q(CLOSURE, "SELECT descendant, ancestor, hops, delay_ms FROM cl"))
def g4_ancestor_closure(s, d):
    return topology.closure(market(s, d))


@query(o.q(CLOSURE, "SELECT descendant, ancestor, hops, delay_ms FROM cl WHERE ancestor = 'r1'"))
def g2_descendants(s, d):
    return topology.descendants(market(s, d), "r1")


@query(o.q(CLOSURE, "SELECT descendant, ancestor, hops, delay_ms FROM cl WHERE descendant = 'c1'"))
def g3_ancestors(s, d):
    return topology.ancestors(market(s, d), "c1")


@query(o.q(CLOSURE, "SELECT descendant, ancestor, hops, delay_ms FROM (SELECT *, row_number() OVER (PARTITION BY descendant ORDER BY hops, delay_ms, ancestor) AS n FROM cl) WHERE n = 1"))
def g6_closest_ancestor(s, d):
    return topology.closest_ancestors(market(s, d))


@query(o.q(o.MARKET, """, m AS (SELECT 'r' || n_regionkey AS r, 'n' || n_nationkey AS stage_id FROM nation UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region)
SELECT stage_id, min(stage_id) OVER (PARTITION BY r) AS component_id FROM m"""))
def g8_components(s, d):
    return topology.components(market(s, d, trade=False))


@query(o.q(CLOSURE, "SELECT n.stage_id, count(*) AS reached FROM cl JOIN ms n ON n.stage_id = cl.ancestor WHERE n.stage_type = 'transform' GROUP BY 1"))
def u3_reachable_counts(s, d):
    """How many stages each transform reaches."""
    return topology.reached(market(s, d), "transform")


@query(o.q(o.MARKET, """SELECT stage_id, problem FROM (SELECT 'n' || n_nationkey AS stage_id, 'negative delay' AS problem FROM nation WHERE n_nationkey % 7 = 3 UNION ALL SELECT 's' || s_suppkey, 'unknown upstream' FROM supplier WHERE s_suppkey % 11 = 5 UNION ALL SELECT 'r' || r_regionkey, 'source has an upstream' FROM region WHERE r_regionkey = 2
  UNION ALL SELECT 'c' || c_custkey, 'unknown type' FROM customer WHERE c_custkey % 13 = 1)"""))
def g7_graph_problems(s, d):
    """What the validator says of the graph with faults at known places."""
    k = F.substring("stage_id", 2, 20).cast("bigint")
    kind = lambda c: F.col("stage_id").startswith(c)
    bad = market(s, d).withColumn("propagation_delay_ms", F.when(kind("n") & (k % 7 == 3), -1.0).otherwise(F.col("propagation_delay_ms"))).withColumn(
        "upstream_ids", F.when(kind("s") & (k % 11 == 5), F.concat("upstream_ids", F.array(F.lit("x")))).when(kind("r") & (k == 2), F.array(F.lit("r3"))).otherwise(F.col("upstream_ids"))
    ).withColumn("stage_type", F.when(kind("c") & (k % 13 == 1), "other").otherwise(F.col("stage_type")))
    return topology.problems(bad)


FAULTS = [("schema_drift", "source_postgres", 0, 864_000, 0.5, 1), ("partition_skew", "source_kafka", 0, 864_000, 4.0, 2), ("throughput_collapse", "sink_warehouse", 86_400, 864_000, 10.0, 3)]


@query(o.q(o.EV, """, f AS (SELECT *, (epoch_us(event_time) - 1704067200000000) / 1e6 AS t FROM ev),
g AS (SELECT *, stage_id = 'source_postgres' AND t BETWEEN 0 AND 864000 AS a, stage_id = 'source_kafka' AND t BETWEEN 0 AND 864000 AS b, stage_id = 'sink_warehouse' AND t BETWEEN 86400 AND 950400 AS c FROM f)
SELECT event_id, CASE WHEN a THEN 'schema_drift' WHEN b THEN 'partition_skew' WHEN c THEN 'throughput_collapse' ELSE fault_label END AS fault_label, CASE WHEN a THEN 'schema_error' ELSE status END AS status,
 (CASE WHEN a THEN trunc(row_count * 0.5) WHEN c THEN greatest(1, trunc(row_count / 10.0)) ELSE row_count END)::INT AS row_count, CASE WHEN b THEN payload_bytes * 4 ELSE payload_bytes END AS payload_bytes, CASE WHEN b THEN latency_ms * 4.0 ELSE latency_ms END AS latency_ms FROM g"""))
def f3_f5_injected_faults(s, d):
    out = simulator.inject(pipeline_events(s, d), FAULTS, "2024-01-01 00:00:00", ("stage_id", "event_id"))
    return out.select("event_id", "fault_label", "status", "row_count", "payload_bytes", "latency_ms")


@query()
def f1_f6_random_faults(s, d):
    specs = [("latency_spike", "source_postgres", 0, 864_000, 5.0, 1), ("dropped_connection", "source_kafka", 0, 864_000, 0.9, 2), ("error_burst", "sink_warehouse", 0, 864_000, 0.8, 3)]
    return simulator.inject(pipeline_events(s, d), specs, "2024-01-01 00:00:00", ("stage_id", "event_id"))


@query(o.q(o.EV, "SELECT stage_id, count(*) AS rows, epoch_us(min(event_time)) AS oldest, round((1706745600000000 - epoch_us(min(event_time))) / 1e6, 6) AS lag_s FROM ev GROUP BY 1"))
def a6_consumer_lag(s, d):
    return reads.consumer_lag(pipeline_events(s, d), F.lit("2024-02-01 00:00:00").cast("timestamp")).select("stage_id", "rows", us("oldest"), r6("lag_s"))


@query(o.q(o.EV, "SELECT stage_id, le, count(*) FILTER (latency_ms <= e) AS n FROM ev, (VALUES ('5', 5.0), ('10', 10), ('25', 25), ('50', 50), ('75', 75), ('100', 100), ('250', 250), ('500', 500), ('+Inf', 1e300)) t(le, e) GROUP BY 1, 2"))
def a14_latency_histogram(s, d):
    return reads.latency_histogram(pipeline_events(s, d))


@query(o.q(o.EV, "SELECT stage_id, row_count, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 1"))
def a15_duplicate_keys(s, d):
    return pipeline_events(s, d).groupBy("stage_id", "row_count").agg(F.count("*").alias("n")).filter("n > 1")


@query(o.q(o.EV, "SELECT stage_id, status, count(*) AS n, avg(err) AS error_rate FROM ev GROUP BY 1, 2"))
def a5_status_counts(s, d):
    return reads.error_summary(pipeline_events(s, d))


@query(o.q(", ".join((o.EV, o.BREAKER, o.LAST, o.OVERVIEW)), """, h AS (SELECT stage_id, p99_ms, coalesce(state, 'unknown') AS breaker_state FROM ov LEFT JOIN lb USING (stage_id)),
c AS (SELECT *, CASE WHEN breaker_state = 'open' OR p99_ms >= 500 THEN 'red' WHEN p99_ms >= 100 THEN 'amber' ELSE 'green' END AS color FROM h)
SELECT stage_id, p99_ms, breaker_state, color, CASE color WHEN 'green' THEN 'healthy' WHEN 'amber' THEN 'degraded' ELSE 'critical' END AS label FROM c"""))
def v1_health_grid(s, d):
    over = reads.overview(pipeline_events(s, d), breakers_now(s, d))
    return reads.health_grid(over).select("stage_id", "p99_ms", "breaker_state", "color", "label")


@query(o.q(o.DETECT, "SELECT epoch_us(date_trunc('day', detected_at)) AS bucket, stage_id, detector_type, count(*) AS anomalies, round(max(abs(z_score)), 6) AS max_abs_z FROM an GROUP BY 1, 2, 3"))
def v2_anomaly_timeline(s, d):
    return reads.timeline(anomalies(s, d)).select(us("bucket"), "stage_id", "detector_type", "anomalies", r6("max_abs_z"))


@query(o.q(", ".join((o.FULL, o.BREAKER, o.LAST, o.OVERVIEW)), """, root AS (SELECT arg_max(candidate, struct_pack(a := triggered_at, b := hypothesis_id)) AS root FROM hy JOIN rk USING (hypothesis_id) WHERE rank = 1)
SELECT st.stage_id, CASE WHEN st.stage_id = root OR state = 'open' THEN 'red' WHEN p99_ms >= 100 THEN 'amber' ELSE 'green' END AS color, (row_number() OVER (ORDER BY st.stage_id) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS x, 0.5::DOUBLE AS y FROM st LEFT JOIN ov USING (stage_id) LEFT JOIN lb USING (stage_id), root"""))
def v3_graph_nodes(s, d):
    over = reads.overview(pipeline_events(s, d), breakers_now(s, d))
    return reads.graph_nodes(config.stages(s), over, incident(s, d)["found"])


@query(o.q(", ".join((o.EV, o.BREAKER, o.LAST, o.STAGES)), """, seen AS (SELECT stage_id, count(*) AS n, max(event_time) AS last FROM ev GROUP BY 1)
SELECT 'metrics' AS component, count(*) > 0 AS ok, count(*)::VARCHAR || ' rows' AS detail FROM ev
UNION ALL SELECT 'stage:' || st.stage_id, coalesce(floor((1706745600000000 - epoch_us(last)) / 1e6) <= 86400, false), coalesce(floor((1706745600000000 - epoch_us(last)) / 1e6)::BIGINT::VARCHAR || ' s behind', 'never seen') FROM st LEFT JOIN seen USING (stage_id)
UNION ALL SELECT 'breaker:' || stage_id, false, state || ', trips ' || trip_count FROM lb WHERE state <> 'closed'"""))
def q8_health(s, d):
    return reads.health_report(pipeline_events(s, d), config.stages(s), breakers_now(s, d), F.lit("2024-02-01 00:00:00").cast("timestamp"))
