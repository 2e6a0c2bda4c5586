"""Spark-native analysis of account-to-account transfers, with training-data operators in ``llm``."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run in Python workers are pickled by value, so executors don't need this package on their path
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
