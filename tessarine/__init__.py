"""Spark-native multilingual retrieval, guardrail and corpus-profiling engine."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
