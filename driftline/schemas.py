"""Schemas of the telemetry tables and wire records."""

from __future__ import annotations

EVENT = "stage_id string, event_time timestamp, latency_ms double, row_count int, payload_bytes bigint, status string, fault_label string, trace_id string"
METRICS = ("latency_ms", "row_count", "error_rate")
ANOMALY = "detector_type string, stage_id string, metric string, signal string, detector_value double, threshold double, z_score double, detected_at timestamp, fault_label string"
BASELINE = "stage_id string, hour_of_week int, metric string, baseline_mean double, baseline_std double, sample_count bigint, fitted_at timestamp"
STAGE = "stage_id string, stage_type string, upstream_ids array<string>, propagation_delay_ms double"
RULE = "rule_ord int, priority int, fault_type string, severity string, stage_type string, action string, description string"
FAULT = "spec_idx int, fault_type string, target_stage_id string, start_offset_s double, duration_s double, magnitude double, seed int"
LOCALIZATION = (
    "hypothesis_id string, triggered_at timestamp, root_cause_stage_id string, posterior_probability double, "
    "ranked_candidates array<struct<stage_id:string,posterior_probability:double>>, evidence_count int, true_label string, created_at timestamp"
)
ACTION = "id string, hypothesis_id string, stage_id string, action string, fault_type string, severity string, rule_matched string, outcome string, triggered_at timestamp, resolved_at timestamp, notes string"
BREAKER = "stage_id string, state string, failure_count int, trip_count int, opened_at timestamp, updated_at timestamp"
