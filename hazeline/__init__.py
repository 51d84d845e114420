"""Exposure and health-outcome panels on Spark: plain DataFrame-to-DataFrame functions."""

import sys

from pyspark import cloudpickle

# The fits run small helpers inside tasks; sent by value, they need no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
