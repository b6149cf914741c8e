"""Directory analytics on Spark: organizations, listings, pages and vectors as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
