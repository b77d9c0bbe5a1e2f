"""Operators for preparing training text, one module each; nothing else in the library imports this.

Their task functions travel to the executors by value, so nothing has to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
