"""Operators of a training-data pipeline over documents, pages, conversations and vectors.

Nothing else in the library imports this subpackage. Its functions travel to
Python workers by value, so workers need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
