"""Structured-log and sample-payload ingest (S5, S6) and log helpers
(P10, P12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.functions.scalars import extract_trace_id, parse_log_ts
from reqlens.operators.timebucket import ts_micros

# Fields the access-log middleware writes and the log shipper extracts.
LOG_SCHEMA = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("ts", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("remote_ip", T.StringType()),
    T.StructField("response_bytes", T.LongType()),
    T.StructField("server_id", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])

SAMPLE_SCHEMA = T.StructType([
    T.StructField("cpu_usage", T.DoubleType()),
    T.StructField("memory_usage", T.DoubleType()),
    T.StructField("_corrupt", T.StringType()),
])

_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def parse_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON log line -> typed fields.  ``ts`` is parsed as RFC3339 with
    a Unix-millisecond fallback (P11); ``trace_id`` comes from the raw line
    (P13); ``corrupt`` is true for lines that are not JSON objects."""
    keep = [c for c in lines.columns if c != line]
    # The parse result is produced by a one-row generator: filters that
    # Catalyst infers later (e.g. join keys not null) cannot be pushed below
    # a generator, so they do not re-run the JSON parse per predicate.
    packed = F.struct(F.from_json(F.col(line), LOG_SCHEMA, _JSON_OPTS).alias("j"),
                      extract_trace_id(F.col(line)).alias("trace_id"))
    out = lines.select(*keep, F.explode(F.array(packed)).alias("_p"))
    fields = [F.col("_p.j." + f.name).alias(f.name) for f in LOG_SCHEMA.fields if f.name not in ("ts", "_corrupt")]
    out = out.select(*keep, *fields,
                     parse_log_ts(F.col("_p.j.ts")).alias("ts"),
                     F.col("_p.trace_id").alias("trace_id"),
                     (F.col("_p.j").isNull() | F.col("_p.j._corrupt").isNotNull()).alias("corrupt"))
    return out.withColumn("ts_us", ts_micros("ts"))


def filter_logs(logs: DataFrame, service: str | None = None, min_status: int | None = None,
                min_duration_s: float | None = None) -> DataFrame:
    """Stream selector and typed line filters on parsed logs."""
    out = logs
    if service is not None:
        out = out.filter(F.col("service") == service)
    if min_status is not None:
        out = out.filter(F.col("status") >= min_status)
    if min_duration_s is not None:
        out = out.filter(F.col("duration") > min_duration_s)
    return out


def relabel(targets: DataFrame) -> DataFrame:
    """P10: discovery labels -> log labels: ``job`` = container name without
    its leading '/', ``container_id`` = first 12 characters, service and
    project copied.  A label whose pattern does not match is left unset."""
    name = F.col("container_name")
    cid = F.col("container_id")
    return targets.select(
        "id",
        F.when(name.rlike("^/.*$"), F.regexp_extract(name, "^/(.*)$", 1)).alias("job"),
        F.col("compose_service").alias("service"),
        F.col("compose_project").alias("project"),
        F.when(F.length(cid) >= 12, F.substring(cid, 1, 12)).alias("container_id"))


def parse_samples(raw: DataFrame, body: str = "body", status: str = "http_status") -> DataFrame:
    """Backend sample payload -> (cpu, memory) with a reject reason.

    Rejected: HTTP status other than 200, a body that is not a JSON object,
    cpu or memory outside [0, 100].  Absent fields decode as 0, as the
    poller's decoder does.  ``valid`` / ``reject_reason`` split the output;
    use :func:`split_samples` for two frames."""
    p = F.from_json(F.col(body), SAMPLE_SCHEMA, _JSON_OPTS)
    out = raw.withColumn("_j", p)
    bad_json = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    cpu = F.coalesce(F.col("_j.cpu_usage"), F.lit(0.0))
    mem = F.coalesce(F.col("_j.memory_usage"), F.lit(0.0))
    reason = (F.when(F.col(status) != 200, "status")
              .when(bad_json, "decode")
              .when((cpu < 0) | (cpu > 100), "cpu")
              .when((mem < 0) | (mem > 100), "memory"))
    out = out.select(*[c for c in raw.columns if c != body],
                     F.when(~bad_json, cpu).alias("cpu_usage"), F.when(~bad_json, mem).alias("memory_usage"),
                     reason.alias("reject_reason"))
    return out.withColumn("valid", F.col("reject_reason").isNull())


def split_samples(raw: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    s = parse_samples(raw, **kw)
    return s.filter("valid"), s.filter("not valid")
