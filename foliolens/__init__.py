"""foliolens: document analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are shipped whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
