"""Learning analytics and corpus preparation as Spark jobs."""

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of the package.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
