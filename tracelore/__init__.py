"""A Spark-native engine that learns from recorded executions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
