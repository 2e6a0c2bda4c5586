"""Training-data operators: media, licences, WARC, search, BPE, mixing, dedup, classifiers.

Nothing else in the library imports this subpackage.  Functions that run in Python workers
are pickled by value, so executors do not need this package on their path.
"""

from pyspark import cloudpickle as _cloudpickle

import flowlattice.llm as _self

_cloudpickle.register_pickle_by_value(_self)
