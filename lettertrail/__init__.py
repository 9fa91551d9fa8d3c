"""Message-corpus analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Python workers get the UDF code with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
