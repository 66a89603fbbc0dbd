"""larkspur: a PySpark-native engine for hybrid retrieval, fact stores, evaluation and event analytics."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
