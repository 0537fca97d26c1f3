"""Functions of this package that run inside Spark tasks are shipped by value, so
executors need not have it on their Python path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
