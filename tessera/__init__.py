"""Tessera: a PySpark-native engine for filing retrieval and corpus analytics."""

import sys

import pyspark.cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Worker functions travel with their code, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
