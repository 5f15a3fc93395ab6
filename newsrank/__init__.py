"""Spark jobs that turn a stream of news items and posts into ranked market events."""

import sys

from pyspark import cloudpickle

# task code travels by value, so workers need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
