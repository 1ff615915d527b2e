"""Spark-native analytics for event-structured detector readout.

The package travels to Python workers by value, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
