"""triagelake: incident analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from triagelake.session import build_session, cut_lineage

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut_lineage"]
