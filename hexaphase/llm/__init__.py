"""Training-data operators. Nothing else in the library imports this package.

Functions that run on executors are pickled by value, so that a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
