"""Operators for preparing training text: deduplication, scoring, mixing, tokens.

Nothing else in the library imports this package; it may be removed as a whole.
"""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
