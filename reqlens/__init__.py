"""reqlens: request-telemetry analytics on Spark.

Subpackages
-----------
sources    readers, writers, schemas and the test-table fixtures
functions  Column-level scalar and aggregate helpers
operators  DataFrame operators: time-bucketed as-of / sweep / running index,
           joins, aggregations, time series, routing what-if, model jobs
plans      compositions (dashboard panels, training set) and the query catalog
streaming  Structured Streaming jobs
"""

from reqlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
