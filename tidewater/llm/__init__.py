"""Operators for preparing training data; nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Executors get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
