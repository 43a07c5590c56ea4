"""Cross-camera video analytics as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get functions of this package by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
