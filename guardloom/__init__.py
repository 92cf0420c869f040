"""Spark-native content-guard analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with what they use, so no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
