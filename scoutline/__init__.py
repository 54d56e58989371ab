"""Location analytics on Spark: operators are functions from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so a worker needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
