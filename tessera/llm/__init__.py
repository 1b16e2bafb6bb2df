"""Operators for preparing training data: filters, deduplication, formatting, sharding, archives."""

import sys

import pyspark.cloudpickle as _cloudpickle

# Worker functions travel with their code, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
