"""Operators of a training-data pipeline, each with its registered query.

Functions of this package reach the executors by value, so a session finds them
whether or not the package is installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
