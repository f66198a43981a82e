"""Urban mobility analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Batch functions travel to the executors by value, so a job needs no copy of
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
