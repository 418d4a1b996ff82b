"""Anomaly detection over many, and very long, time series with Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors whole, which need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
