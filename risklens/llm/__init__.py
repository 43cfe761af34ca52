"""Operators for preparing language-model training data, one module each.

Functions that run in tasks are pickled by value, so executors need Python and
the public libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
