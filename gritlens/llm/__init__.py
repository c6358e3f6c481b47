"""Operators for training-data pipelines.

Nothing outside this package imports it. Its functions travel to Python workers
by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
