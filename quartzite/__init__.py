"""Quartzite: code-quality and text-corpus analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of it on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
