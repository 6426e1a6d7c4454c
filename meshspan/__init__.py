"""Radio-mesh planning and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
