"""Record linkage and relationship networks on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no copy of the package: what tasks use of it is sent with them.
register_pickle_by_value(sys.modules[__name__])
