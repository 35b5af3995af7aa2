"""Column-level scalar functions (P1-P16).  All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- P1: URL -> host, port -------------------------------------------------

def url_host(url) -> Column:
    """Host part of an absolute URL; null when the URL does not parse."""
    return _blank_null(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]+)", 1))


def _blank_null(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def url_port_text(url) -> Column:
    """Raw port text of a URL ('' when absent)."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^:/?#]+:([^/?#]*)", 1)


def url_port(url, default: int = 80) -> Column:
    """Port as INT; ``default`` when absent; null when not a number (reject)."""
    txt = url_port_text(url)
    return F.when(txt == "", F.lit(default)).otherwise(
        F.when(txt.rlike(r"^[0-9]+$"), txt.try_cast("int")))


def url_is_valid(url) -> Column:
    return url_host(url).isNotNull() & url_port(url).isNotNull()


def with_host_port(df: DataFrame, url: str = "url", default: int = 80) -> DataFrame:
    """Adds ``host`` and ``port`` parsed from ``url`` (P1).  The pair is
    produced by a one-row generator so that later filters on it (valid
    URLs only) are not pushed below the parse and re-run the regexes."""
    pair = F.struct(url_host(url).alias("host"), url_port(url, default).alias("port"))
    out = df.select("*", F.explode(F.array(pair)).alias("_hp"))
    return out.select(*df.columns, F.col("_hp.host").alias("host"), F.col("_hp.port").alias("port"))


# --- P2-P4 -------------------------------------------------------------------

def active_servers(servers: DataFrame) -> DataFrame:
    """Active servers ordered by name."""
    return servers.filter(F.col("is_active")).orderBy("name")


def lookback(df: DataFrame, ts: str, as_of: str, days: float = 7, seconds: int | None = None) -> DataFrame:
    """Rows with ``ts >= as_of - N`` (and not after ``as_of``)."""
    span = int(seconds if seconds is not None else days * 86400)
    hi = F.lit(as_of).cast("timestamp_ntz")
    lo = hi - F.expr(f"INTERVAL {span} SECONDS")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) <= hi))


def to_millis(micros) -> Column:
    """Duration in micros -> integer ms, truncating."""
    return F.call_function("div", _c(micros).cast("bigint"), F.lit(1000).cast("bigint"))


# --- P5-P8 -------------------------------------------------------------------

def is_success(status_code, transport_error) -> Column:
    """P5: no transport error and status < 500."""
    return F.coalesce(~_c(transport_error), F.lit(True)) & (effective_status(status_code, transport_error) < 500)


def effective_status(status_code, transport_error) -> Column:
    """P5: 502 when the transport failed, else the upstream status."""
    return F.when(F.coalesce(_c(transport_error), F.lit(False)), F.lit(502)).otherwise(_c(status_code))


def severity(status_code, error=None) -> Column:
    """Error / warn / info level of an access-log line."""
    st = _c(status_code)
    lvl = F.when(st >= 500, "error").when(st >= 400, "warn").otherwise("info")
    return lvl if error is None else F.when(_c(error).isNotNull(), "error").otherwise(lvl)


def severity_message(status_code, error=None) -> Column:
    st = _c(status_code)
    msg = F.when(st >= 500, "server error").when(st >= 400, "client error").otherwise("request")
    return msg if error is None else F.when(_c(error).isNotNull(), "request error").otherwise(msg)


def is_server_error(status_code) -> Column:
    """Anchored ``5..`` match on the status label."""
    return _c(status_code).cast("string").rlike("^5..$")


def clamp(x, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def round1(x) -> Column:
    """One decimal, half away from zero."""
    return F.round(_c(x), 1)


def stable_hash(key, seed: int = 42) -> Column:
    """A number below 2^32 that depends on the key's text and the seed only (the
    first eight hex digits of an MD5), the same in every engine; null as ''."""
    text = F.concat(F.coalesce(_c(key).cast("string"), F.lit("")), F.lit(f"#{int(seed)}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


# --- P9-P16 ------------------------------------------------------------------

def fill_request_id(header) -> Column:
    """Keep a non-empty header, else a fresh UUID (non-deterministic:
    materialise before reusing the column)."""
    return F.coalesce(F.nullif(_c(header), F.lit("")), F.expr("uuid()"))


def parse_log_ts(ts) -> Column:
    """RFC3339 (nanos truncate to micros), else Unix milliseconds; as
    TIMESTAMP_NTZ in UTC."""
    t = _c(ts)
    is_ms = t.rlike("^-?[0-9]{1,18}$")
    rfc = F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"))
    # Digits-only text is never RFC3339: test it first and skip the parser.
    return F.when(is_ms, F.timestamp_millis(t.cast("bigint"))).otherwise(rfc).cast("timestamp_ntz")


def extract_trace_id(line) -> Column:
    """``"traceID":"(\\w+)"`` capture, null when absent."""
    return _blank_null(F.regexp_extract(_c(line), r'"traceID":"(\w+)"', 1))


def breaker_label(state) -> Column:
    """0/1 -> CLOSED/OPEN."""
    s = _c(state)
    return F.when(s == 1, "OPEN").when(s == 0, "CLOSED")


def select_servers(df: DataFrame, server_ids: Iterable[int] | None = None, col: str = "server_id") -> DataFrame:
    """Multi-select filter; None means All."""
    if server_ids is None:
        return df
    return df.filter(F.col(col).isin(list(server_ids)))


def fill_and_clip(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Null -> 0, then clip below at 0."""
    return df.select(*[
        F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias(c) if c in set(cols) else F.col(c)
        for c in df.columns])


def dedup_requests(requests: DataFrame, key: str = "id") -> DataFrame:
    """Drop double-inserted request rows."""
    return requests.dropDuplicates([key])
