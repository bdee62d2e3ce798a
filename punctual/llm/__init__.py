"""Operators for preparing training text.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: no copy of it has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
