"""Market-microstructure analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from .plans import Axis, DAILY, TICKS

# The few functions that run in Python workers travel with the job, so that executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Axis", "DAILY", "TICKS"]
