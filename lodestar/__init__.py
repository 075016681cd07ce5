"""A PySpark-native engine for time-series, spatial, vector and text analytics.

Functions of this package return Columns or DataFrames.  Python functions that
run inside tasks are shipped to the executors by value, so that a cluster needs
no installation of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
