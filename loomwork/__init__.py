"""Corpus, evaluation and state-diff analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
