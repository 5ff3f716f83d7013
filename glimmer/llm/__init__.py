"""Operators for training-data pipelines: one module for each, and ``registry`` with their queries.

Nothing outside this package imports it.  Functions that run on executors are
pickled by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
