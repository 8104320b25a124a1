"""Ampertide: intraday electricity market analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to the executors travel by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
