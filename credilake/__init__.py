"""credilake: credit-viability analytics over applicant tables, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run inside Python workers travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
