"""Wire format of events and anomalies: compact JSON with a schema version, and decoding with an error for each bad row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.metrics import iso

VERSION, ERROR_CHARS = 1, 200
EVENT_FIELDS = {"stage_id": "string", "event_time": "timestamp", "latency_ms": "double", "row_count": "int", "payload_bytes": "bigint", "status": "string"}
ANOMALY_FIELDS = {"detector_type": "string", "stage_id": "string", "metric": "string", "signal": "string", "detector_value": "double", "threshold": "double", "z_score": "double", "detected_at": "timestamp"}
OPTIONAL = {"event": ("fault_label", "trace_id"), "anomaly": ("fault_label",)}


def encode(kind: str = "event") -> Column:
    fields = EVENT_FIELDS if kind == "event" else ANOMALY_FIELDS
    cols = [F.lit(VERSION).alias("schema_version"), *((iso(c) if t == "timestamp" else F.col(c)).alias(c) for c, t in fields.items()), *(F.col(c) for c in OPTIONAL[kind])]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def decode(messages: DataFrame, value: str = "value", kind: str = "event") -> DataFrame:
    """Adds the typed fields and `error`: NULL, or what is wrong with the message (fields are NULL then). A message is parsed once.
    Numbers may be JSON strings; times without an offset are UTC; unknown fields are ignored; a null required field is an error."""
    fields = EVENT_FIELDS if kind == "event" else ANOMALY_FIELDS
    text = F.col(value) if dict(messages.dtypes)[value] == "string" else F.make_valid_utf8(F.col(value).cast("string"))
    v, r = F.col("_v"), lambda c: F.col(f"_r_{c}")
    names = ("schema_version", *fields, *OPTIONAL[kind])

    def typed(c: str, kind: str) -> Column:
        if kind == "timestamp":
            return F.try_to_timestamp(r(c))
        if kind in ("int", "bigint"):
            # through double only what isn't written as a whole number: doubles hold integers up to 2^53
            whole = F.when(F.trim(r(c)).rlike("^[+-]?[0-9]+$"), r(c).try_cast("bigint"))
            return F.coalesce(whole, r(c).try_cast("double").try_cast("bigint")).try_cast(kind)
        return r(c).try_cast(kind)

    # inline() of one row keeps each step's values from being written out again in the next one's expressions
    one = lambda *cols: F.inline(F.array(F.struct(*cols)))
    m = messages.withColumn("_s", text).withColumn("_v", F.when(F.ltrim("_s").startswith("{"), F.try_parse_json("_s")))
    absent = F.array_compact(F.array(*(F.when(F.try_variant_get(v, f"$.{c}", "variant").isNull(), F.lit(c)) for c in fields)))
    m = m.select(*messages.columns, one(v.isNotNull().alias("_json"), absent.alias("_absent"), *(F.try_variant_get(v, f"$.{c}", "string").alias(f"_r_{c}") for c in names)))
    m = m.select(*messages.columns, "_json", "_absent", *(f"_r_{c}" for c in ("schema_version", *OPTIONAL[kind])), one(*(typed(c, k).alias(f"_t_{c}") for c, k in fields.items())))
    wrong = F.array_compact(F.array(*(F.when(F.col(f"_t_{c}").isNull(), F.lit(c)) for c in fields)))
    error = (
        F.when(~F.col("_json"), "invalid json").when(~F.coalesce(r("schema_version").try_cast("int") == VERSION, F.lit(False)), "unsupported schema_version")
        .when(F.size("_absent") > 0, F.concat(F.lit("missing field: "), F.array_join("_absent", ","))).when(F.size(wrong) > 0, F.concat(F.lit("invalid field: "), F.array_join(wrong, ",")))
    )
    good = F.col("error").isNull()
    out = [F.when(good, F.col(f"_t_{c}")).alias(c) for c in fields] + [F.when(good, r(c)).alias(c) for c in OPTIONAL[kind]]
    return m.withColumn("error", error).select(*messages.columns, "error", *out)


def listed(c: str) -> Column:
    """A list of rows (ranked candidates, evidence) as JSON; times in ISO form with microseconds."""
    return F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"})


def ranked(c: str) -> Column:
    """Ranked candidates from their JSON."""
    return F.from_json(c, "array<struct<stage_id: string, posterior_probability: double>>")


def evidence(c: str) -> Column:
    """An alert's or a hypothesis' evidence from its JSON."""
    fields = "detected_at: timestamp, event_id: bigint, metric: string, detector_type: string, signal: string, stage_id: string, detector_value: double, z_score: double"
    return F.from_json(c, f"array<struct<{fields}>>", {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"})


def dead_letter(bad: DataFrame, topic: str, value: str = "value", received_at: Column | None = None) -> DataFrame:
    """The envelope for <topic>.dlq; bad has partition, offset, error and the raw message."""
    raw = F.col(value) if dict(bad.dtypes)[value] == "string" else F.make_valid_utf8(F.col(value).cast("string"))
    body = F.struct(
        F.lit(topic).alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.substring("error", 1, ERROR_CHARS).alias("error"),
        iso(received_at if received_at is not None else F.current_timestamp()).alias("received_at"), raw.alias("raw_payload"),
    )
    return bad.select(F.lit(topic + ".dlq").alias("topic"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
