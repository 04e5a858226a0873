"""Question-bank analytics on Spark.

Functions that run inside Python tasks are shipped by value, so that executors
need Spark and the third-party libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
