"""Cohort analytics on Spark: risk-prediction cohorts built from event tables.

Every public function takes and returns Spark DataFrames.  The work runs as
DataFrame jobs (joins, grouped aggregation, windows); pandas appears only inside
Spark tasks, on groups whose size is bounded by construction.
"""

import sys as _sys

# Functions shipped to Python workers (grouped-map sweeps) are pickled by value,
# so executors need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from cohortkit.session import get_spark, checkpoint_dir, materialize  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
