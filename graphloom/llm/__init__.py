"""Corpus operators for training data. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors need not have the package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
