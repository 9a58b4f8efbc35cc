"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so a cluster needs no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
