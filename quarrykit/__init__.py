"""Spark-native retrieval and corpus analytics.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and parsers), ``plans`` (named queries with
their SQL), ``streaming`` (incremental and Structured Streaming parts).
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are pickled by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
