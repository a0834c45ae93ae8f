"""Supply-chain risk analytics as Spark DataFrame operators (batch and streaming)."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions handed to Python workers travel with their helpers, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
