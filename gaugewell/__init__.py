"""Machine-sensor monitoring on Spark: prepare, train, score, count, report."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
