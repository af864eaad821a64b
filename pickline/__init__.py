"""Curating large collections from noisy judgments, on Spark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so they need no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
