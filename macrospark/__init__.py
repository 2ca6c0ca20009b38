"""macrospark: Spark-native analytics for large collections of monthly series."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
