"""Aggregate Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(cond: Column) -> Column:
    """A2: ``COUNT(*) FILTER (WHERE cond)`` as a BIGINT aggregate."""
    return F.count_if(cond).cast("bigint")


def exact_percentile(x, q):
    """Exact percentile with linear interpolation between order
    statistics (same definition as numpy's default and ``quantile_cont``).
    ``q`` may be a float or a list of floats (-> ARRAY<DOUBLE>)."""
    c = F.col(x) if isinstance(x, str) else x
    if isinstance(q, (list, tuple)):
        return F.percentile(c.cast("double"), F.array(*[F.lit(float(v)) for v in q]))
    return F.percentile(c.cast("double"), F.lit(float(q)))
