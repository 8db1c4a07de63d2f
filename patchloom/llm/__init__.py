"""Operators for building training data: deduplication, extraction, filtering, mixing,
packing, search and scans. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so workers need numpy, pandas and Arrow
# but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
