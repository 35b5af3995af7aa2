"""Size-checked broadcast and lineage cuts.

A side is broadcast only after counting it against a bound; beyond the bound
the join is left to the planner (shuffle join, with AQE able to re-plan).
The count is cheap for what we call it on: the server registry, pools, slot
tables, weight overrides, per-server tables and per-tick model choices --
one row per server or per tick, never one per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result that later operators read
    more than once (the bucket-carry operators read their input twice, so a
    chain of them would otherwise recompute its base exponentially).

    Uses a reliable ``checkpoint`` to the shared folder named by
    ``spark.checkpoint.dir`` (never a local checkpoint), so a lost executor
    does not lose the data; files are cleaned when the frame is released."""
    from reqlens.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
