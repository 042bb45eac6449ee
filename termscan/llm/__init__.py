"""Operators for preparing training text. Nothing else in the library imports this subpackage.

Its functions travel to the executors by value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
