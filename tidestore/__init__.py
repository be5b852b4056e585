"""A time-series sample store and training-data operators on Spark.

Functions are shipped to executors by value, so that no executor needs the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
