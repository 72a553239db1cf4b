"""ctxloom: context retrieval and corpus preparation as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors get the library's functions by value: a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
