"""Operators for preparing large-scale training data.

Nothing else in the package imports this subpackage; it can be removed as a whole. Its functions are
shipped to executors by value, so that no executor needs the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
