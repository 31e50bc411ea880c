"""DuckDB SQL for the engine's queries, composed of common parts."""

from __future__ import annotations

from driftline.config import DEFAULT_RULES, DEFAULT_STAGES

NAMES = ", ".join(f"'{s[0]}'" for s in DEFAULT_STAGES)
EV = f"""ev AS (SELECT event_id, ([{NAMES}])[(user_id % 5) + 1] AS stage_id, ts AS event_time, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS INT) AS row_count,
  length(props)::BIGINT AS payload_bytes, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 'error_burst' END AS fault_label,
  lpad(lower(to_hex(event_id)), 32, '0') AS trace_id, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS err FROM events)"""
HOW = "((isodow(event_time) - 1) * 24 + hour(event_time))::INT"
LONG = f"""lm AS (SELECT event_id, stage_id, event_time, fault_label, {HOW} AS hour_of_week, 'latency_ms' AS metric, latency_ms AS value FROM ev
  UNION ALL SELECT event_id, stage_id, event_time, fault_label, {HOW}, 'row_count', row_count::DOUBLE FROM ev UNION ALL SELECT event_id, stage_id, event_time, fault_label, {HOW}, 'error_rate', err FROM ev)"""


def base(seasonal: bool) -> str:
    keys = "stage_id, hour_of_week" if seasonal else "stage_id"
    return f"""base AS (SELECT {keys}, metric, avg(value) AS baseline_mean, coalesce(stddev_samp(value), 0) AS baseline_std, count(*) AS sample_count FROM lm
  WHERE event_time >= (SELECT max(event_time) FROM ev) - INTERVAL 28 DAY GROUP BY {keys}, metric)"""


def z(seasonal: bool) -> str:
    keys = "stage_id, hour_of_week, metric" if seasonal else "stage_id, metric"
    return f"z AS (SELECT lm.*, CASE WHEN baseline_std <> 0 THEN (value - baseline_mean) / baseline_std END AS z FROM lm LEFT JOIN base USING ({keys}))"


ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY stage_id, metric ORDER BY event_time, event_id) AS n FROM z WHERE z IS NOT NULL)"
CUSUM = """cu AS (SELECT stage_id, metric, n, event_id, event_time, fault_label, z, greatest(0, z - 0.5) AS u0, greatest(0, -z - 0.5) AS l0 FROM o WHERE n = 1
  UNION ALL SELECT o.stage_id, o.metric, o.n, o.event_id, o.event_time, o.fault_label, o.z, greatest(0, CASE WHEN u0 > 4 THEN 0 ELSE u0 END + o.z - 0.5), greatest(0, CASE WHEN l0 > 4 THEN 0 ELSE l0 END - o.z - 0.5)
  FROM cu JOIN o ON o.stage_id = cu.stage_id AND o.metric = cu.metric AND o.n = cu.n + 1),
ca AS (SELECT 'cusum' AS detector_type, stage_id, metric, 'upper' AS signal, u0 AS detector_value, 4.0::DOUBLE AS threshold, z AS z_score, event_time AS detected_at, fault_label, event_id FROM cu WHERE u0 > 4
  UNION ALL SELECT 'cusum', stage_id, metric, 'lower', l0, 4.0, z, event_time, fault_label, event_id FROM cu WHERE l0 > 4)"""
LIMIT = "3.0 * sqrt((0.3 / 1.7) * (1 - pow(0.7, 2 * {n})))"
EWMA = f"""ew AS (SELECT stage_id, metric, n, event_id, event_time, fault_label, z, 0.3 * z AS e FROM o WHERE n = 1
  UNION ALL SELECT o.stage_id, o.metric, o.n, o.event_id, o.event_time, o.fault_label, o.z, 0.3 * o.z + 0.7 * CASE WHEN abs(ew.e) > {LIMIT.format(n="ew.n")} THEN 0 ELSE ew.e END
  FROM ew JOIN o ON o.stage_id = ew.stage_id AND o.metric = ew.metric AND o.n = ew.n + 1),
ea AS (SELECT 'ewma' AS detector_type, stage_id, metric, CASE WHEN e > 0 THEN 'upper' ELSE 'lower' END AS signal, e AS detector_value, {LIMIT.format(n="n")} AS threshold, z AS z_score, event_time AS detected_at, fault_label, event_id
  FROM ew WHERE abs(e) > {LIMIT.format(n="n")})"""
AN = "an AS (SELECT * FROM ca UNION ALL SELECT * FROM ea)"
DETECT = ", ".join((EV, LONG, base(False), z(False), ORDERED, CUSUM, EWMA, AN))
STAGES = "st(stage_id, stage_type, delay_ms) AS (VALUES " + ", ".join(f"('{s}', '{t}', {d}::DOUBLE)" for s, t, _, d in DEFAULT_STAGES) + ")"
EDGES = "ed(src, dst, delay_ms) AS (VALUES " + ", ".join(f"('{u}', '{s}', {d}::DOUBLE)" for s, _, ups, d in DEFAULT_STAGES for u in ups) + ")"
WALK = """walk AS (SELECT dst AS descendant, src AS ancestor, 1 AS hops, delay_ms FROM ed UNION ALL SELECT w.descendant, e.src, w.hops + 1, w.delay_ms + e.delay_ms FROM walk w JOIN ed e ON w.ancestor = e.dst),
cl AS (SELECT descendant, ancestor, min(hops) AS hops, min(delay_ms) AS delay_ms FROM walk GROUP BY 1, 2), near AS (SELECT * FROM cl UNION ALL SELECT stage_id, stage_id, 0, NULL FROM st)"""
MARKET = """ed AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey::DOUBLE AS delay_ms FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, (s_suppkey % 50)::DOUBLE FROM supplier
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, (c_custkey % 100)::DOUBLE FROM customer UNION ALL SELECT DISTINCT 's' || l_suppkey, 'c' || c_custkey, (c_custkey % 100)::DOUBLE FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey),
ms AS (SELECT 'r' || r_regionkey AS stage_id, 'source' AS stage_type FROM region UNION ALL SELECT 'n' || n_nationkey, 'transform' FROM nation UNION ALL SELECT 's' || s_suppkey, 'transform' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'sink' FROM customer)"""
MARKET_WALK = """walk AS (SELECT dst AS descendant, src AS ancestor, 1 AS hops, delay_ms FROM ed UNION ALL SELECT w.descendant, e.src, w.hops + 1, w.delay_ms + e.delay_ms FROM walk w JOIN ed e ON w.ancestor = e.dst),
cl AS (SELECT descendant, ancestor, min(hops) AS hops, min(delay_ms) AS delay_ms FROM walk GROUP BY 1, 2)"""
SESSIONS = """sg AS (SELECT *, sum(f) OVER (ORDER BY detected_at, event_id, metric, detector_type ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN detected_at - lag(detected_at) OVER (ORDER BY detected_at, event_id, metric, detector_type) <= INTERVAL 900 SECOND THEN 0 ELSE 1 END AS f FROM an)),
hy AS (SELECT g, substring(sha256('hypothesis:' || epoch_us(min(detected_at))::VARCHAR), 1, 32) AS hypothesis_id, min(detected_at) AS triggered_at, max(detected_at) AS closed_at, count(*) AS evidence_count FROM sg GROUP BY g),
evd AS (SELECT sg.*, hypothesis_id FROM sg JOIN hy USING (g))"""
SCORES = """fs AS (SELECT hypothesis_id, stage_id AS candidate, min(detected_at) AS seen FROM evd GROUP BY 1, 2),
pr AS (SELECT evd.hypothesis_id, near.ancestor AS candidate, hops, delay_ms, (epoch_us(detected_at) - epoch_us(seen)) / 1000.0 AS lag, seen FROM evd JOIN near ON evd.stage_id = near.descendant LEFT JOIN fs ON fs.hypothesis_id = evd.hypothesis_id AND fs.candidate = near.ancestor),
sc AS (SELECT hypothesis_id, candidate, sum(CASE WHEN hops = 0 THEN 1.0::DOUBLE ELSE (CASE WHEN seen IS NULL THEN 1.0 WHEN lag < 0 THEN 0.5 WHEN abs(lag - delay_ms) <= greatest(0.5 * delay_ms, 100.0) THEN 2.0 ELSE 1.0 END) / (delay_ms + 1) END) AS score FROM pr GROUP BY 1, 2),
po AS (SELECT *, score / sum(score) OVER (PARTITION BY hypothesis_id) AS p FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY round(p, 9) DESC, candidate) AS rank FROM po)"""
RULES = "ru(ord, priority, ft, sv, sty, action) AS (VALUES " + ", ".join(f"({i}, {r[0]}, " + ", ".join("NULL" if v is None else f"'{v}'" for v in r[1:]) + ")" for i, r in enumerate(DEFAULT_RULES)) + ")"
DECIDE = """df AS (SELECT hypothesis_id, fault_label AS fault_type FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY c DESC, t, fault_label) AS r FROM (SELECT hypothesis_id, fault_label, count(*) AS c, min(detected_at) AS t FROM evd WHERE fault_label IS NOT NULL GROUP BY 1, 2)) WHERE r = 1),
cs AS (SELECT hy.hypothesis_id, triggered_at, rk.candidate AS target_stage_id, fault_type, p, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS severity, st.stage_type
  FROM hy JOIN rk ON rk.hypothesis_id = hy.hypothesis_id AND rk.rank = 1 LEFT JOIN df ON df.hypothesis_id = hy.hypothesis_id LEFT JOIN st ON st.stage_id = rk.candidate),
de AS (SELECT * FROM (SELECT cs.*, ru.action, coalesce(ft, 'any') || '/' || coalesce(sv, 'any') || '/' || coalesce(sty, 'any') AS rule_matched, row_number() OVER (PARTITION BY hypothesis_id ORDER BY priority, ord) AS r FROM cs JOIN ru ON (ft IS NULL OR ft = fault_type) AND (sv IS NULL OR sv = severity) AND (sty IS NULL OR sty = stage_type)) WHERE r = 1),
ac AS (SELECT substring(sha256('action:' || hypothesis_id || ':' || action), 1, 32) AS id, * FROM de)"""
FULL = ", ".join((DETECT, STAGES, EDGES, WALK, SESSIONS, SCORES, RULES, DECIDE))
ALERTS = """na AS (SELECT *, epoch_us(detected_at) AS t, row_number() OVER (ORDER BY detected_at, event_id, metric, detector_type, signal) AS n FROM an),
mine AS (SELECT descendant AS stage_id, list(ancestor) AS m FROM near GROUP BY 1),
placed AS (SELECT n, 1::BIGINT AS serial, 1::BIGINT AS opened, [struct_pack(serial := 1::BIGINT, start := t, reach := m)] AS open FROM na JOIN mine USING (stage_id) WHERE n = 1
  UNION ALL SELECT n, coalesce(hit, opened + 1), CASE WHEN hit IS NULL THEN opened + 1 ELSE opened END,
    CASE WHEN hit IS NULL THEN list_append(o, struct_pack(serial := opened + 1, start := t, reach := m)) ELSE list_transform(o, lambda g: CASE WHEN g.serial = hit THEN struct_pack(serial := g.serial, start := g.start, reach := list_distinct(list_concat(g.reach, m))) ELSE g END) END
  FROM (SELECT *, list_filter(o, lambda g: list_has_any(g.reach, m))[1].serial AS hit FROM (SELECT a.n, a.t, x.m, p.opened, list_filter(p.open, lambda g: a.t - g.start <= 900000000) AS o FROM placed p JOIN na a ON a.n = p.n + 1 JOIN mine x ON x.stage_id = a.stage_id)))"""
BREAKER = """oc AS (SELECT stage_id, event_id, event_time, epoch_us(event_time) AS us, status = 'ok' AS ok, row_number() OVER (PARTITION BY stage_id ORDER BY event_time, event_id) AS n FROM ev),
br AS (SELECT stage_id, n, event_id, event_time, us, CASE WHEN NOT ok AND 2 <= 1 THEN 'open' ELSE 'closed' END AS state, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0 AS trips, NULL::BIGINT AS opened FROM oc WHERE n = 1
  UNION ALL SELECT stage_id, n, event_id, event_time, us,
    CASE WHEN s = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN s = 'half_open' OR fails + 1 >= 2 THEN 'open' ELSE s END,
    CASE WHEN s = 'open' THEN fails WHEN ok THEN 0 WHEN s = 'half_open' OR fails + 1 >= 2 THEN 0 ELSE fails + 1 END,
    CASE WHEN s <> 'open' AND NOT ok AND (s = 'half_open' OR fails + 1 >= 2) THEN trips + 1 ELSE trips END,
    CASE WHEN s = 'open' THEN opened WHEN ok THEN CASE WHEN s = 'half_open' THEN NULL ELSE opened END WHEN s = 'half_open' OR fails + 1 >= 2 THEN us ELSE opened END
  FROM (SELECT oc.*, br.fails, br.trips, br.opened, CASE WHEN br.state = 'open' AND oc.us - br.opened >= least(60.0 * pow(2.0, br.trips - 1), 3600.0) * 1e6 THEN 'half_open' ELSE br.state END AS s FROM br JOIN oc ON oc.stage_id = br.stage_id AND oc.n = br.n + 1))"""
LAST = "lb AS (SELECT stage_id, arg_max(state, n) AS state, arg_max(fails, n) AS failure_count, arg_max(trips, n) AS trip_count FROM br GROUP BY 1)"
OVERVIEW = "ov AS (SELECT stage_id, round(coalesce(quantile_cont(latency_ms, 0.99), 0), 3) AS p99_ms, count(*) AS event_count, max(event_time) AS last_event_at FROM ev GROUP BY 1)"


def q(parts: str, select: str) -> str:
    return f"WITH RECURSIVE {parts} {select}"


def window(duration: int, minimum: int) -> str:
    w = f"OVER (PARTITION BY stage_id ORDER BY event_time RANGE BETWEEN INTERVAL {duration} SECOND PRECEDING AND CURRENT ROW)"
    p = ", ".join(f"quantile_cont(latency_ms, {v}) {w} AS {n}" for n, v in (("a", 0.5), ("b", 0.95), ("c", 0.99)))
    keep = lambda c: f"CASE WHEN n >= {minimum} THEN round({c}, 6) END"
    return f"""ws AS (SELECT event_id, stage_id, n::BIGINT AS sample_count, n >= {minimum} AS is_stable, {keep("a")} AS p50_latency_ms, {keep("b")} AS p95_latency_ms, {keep("c")} AS p99_latency_ms, {keep("d")} AS mean_latency_ms, {keep("e")} AS mean_row_count, {keep("f")} AS error_rate
  FROM (SELECT event_id, stage_id, count(*) {w} AS n, {p}, avg(latency_ms) {w} AS d, avg(row_count) {w} AS e, avg(err) {w} AS f FROM ev))"""
