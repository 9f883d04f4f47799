"""Provisio: retrieval, citation and evaluation analytics over legal text, as Spark plans.

The package is pickled by value, so executors need no copy of it on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
