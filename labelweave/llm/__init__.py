"""Operators for preparing language-model training text at scale.

Each module holds one operator (a function of DataFrames) and the query that
applies it to its whole table. Nothing else in the library imports this
subpackage. Its functions travel to the executors by value, so a cluster needs
no copy of the package on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
