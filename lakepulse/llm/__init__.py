"""Operators for building training corpora from documents and pages.

Functions of this package that run inside tasks are pickled by value, so executors need the libraries
they import, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
