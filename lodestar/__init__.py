"""Lodestar: analytics operators for PySpark (monitoring, reporting, retrieval, statistics).

Functions that run inside Python workers are pickled by value, so executors
need nothing installed beyond PySpark's own dependencies.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
