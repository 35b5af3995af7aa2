"""Server registry operations: server list (S4), upsert (S9), status
updates (S10).  The registry has one row per backend, so it is small next
to the request log; the configuration inputs (URL lists, change logs) are
processed as ordinary distributed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqlens.functions.scalars import with_host_port
from reqlens.operators.sizing import materialize

REGISTRY_COLUMNS = ["id", "name", "ip_address", "port", "status", "is_active", "weight", "capacity",
                    "created_at", "updated_at"]


def server_list_to_rows(lists: DataFrame, raw: str = "raw", key: str = "list_id") -> DataFrame:
    """Comma-separated server list -> one row per entry, trimmed,
    empty entries dropped, ``pos`` = 0-based position among kept entries."""
    kept = F.filter(F.transform(F.split(F.col(raw), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(key, F.posexplode(kept).alias("pos", "url"))


def _with_audit(servers: DataFrame) -> DataFrame:
    out = servers
    for c in ("created_at", "updated_at"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    return out.select(*REGISTRY_COLUMNS)


def upsert_servers(current: DataFrame, incoming: DataFrame, now: str, url: str = "url",
                   pos: str = "pos") -> DataFrame:
    """Register URLs keyed by (host, port).  Known keys keep id, name,
    weight, capacity and created_at and become active (``updated_at`` =
    now); unknown keys are inserted with the next ids in first-seen order
    (and count as updated when listed more than once); invalid URLs are
    skipped.  Running it twice gives the same registry."""
    ts = F.lit(now).cast("timestamp_ntz")
    cur = _with_audit(current)
    inc = with_host_port(incoming.select(F.col(url).alias("url"), F.col(pos).alias("pos")), "url")
    inc = inc.withColumnRenamed("host", "ip_address")
    inc = inc.filter(F.col("ip_address").isNotNull() & F.col("port").isNotNull())
    # one row per (host, port): small, and read by both the update and the
    # insert branch, so it is materialised once
    inc = materialize(inc.groupBy("ip_address", "port").agg(F.min_by("url", "pos").alias("url"),
                                                              F.min("pos").alias("pos"),
                                                              F.count(F.lit(1)).alias("_n")))
    keys = ["ip_address", "port"]
    hit = cur.join(inc.select(*keys, F.lit(True).alias("_seen")), keys, "left")
    updated = hit.select(
        "id", "name", *keys,
        F.when(F.col("_seen"), F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_seen"), F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
        "weight", "capacity", "created_at",
        F.when(F.col("_seen"), ts).otherwise(F.col("updated_at")).alias("updated_at"))
    new = inc.join(cur.select(*keys), keys, "left_anti")
    max_id = cur.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]  # one scalar
    order = Window.partitionBy().orderBy("pos", *keys)  # new registry rows only
    inserted = new.select(
        (F.lit(int(max_id)) + F.row_number().over(order)).cast(cur.schema["id"].dataType).alias("id"),
        F.col("url").alias("name"), *keys, F.lit("active").alias("status"), F.lit(True).alias("is_active"),
        F.lit(1).cast(cur.schema["weight"].dataType).alias("weight"),
        F.lit(10).cast(cur.schema["capacity"].dataType).alias("capacity"),
        ts.alias("created_at"),
        # a URL listed again after its insert is an update of the new row
        F.when(F.col("_n") > 1, ts).otherwise(F.lit(None).cast("timestamp_ntz")).alias("updated_at"))
    return updated.unionByName(inserted.select(*[F.col(c).cast(updated.schema[c].dataType) for c in updated.columns]))


def apply_status(servers: DataFrame, changes: DataFrame, key: str = "server_id", ts: str = "changed_at",
                 tie: str = "change_id") -> DataFrame:
    """The latest status change per server (by time, then change id)
    sets ``is_active`` and ``updated_at``; servers without changes are
    unchanged; changes for unknown servers are ignored."""
    cur = _with_audit(servers)
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col("is_active").alias("a"), F.col(ts).alias("t")),
                                             F.struct(ts, tie)).alias("_c"))
    j = cur.join(last.withColumnRenamed(key, "id"), "id", "left")
    return j.select(
        "id", "name", "ip_address", "port", "status",
        F.coalesce(F.col("_c.a"), F.col("is_active")).alias("is_active"), "weight", "capacity", "created_at",
        F.coalesce(F.col("_c.t").cast("timestamp_ntz"), F.col("updated_at")).alias("updated_at"))
