"""Document-knowledge and usage analytics as Spark jobs.

Every operator takes DataFrames plus plain parameters and returns a DataFrame; one job serves all
tenants at once.
"""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
