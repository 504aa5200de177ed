"""forecourt: Spark-first catalogue, conversation and corpus analytics."""

from pyspark.cloudpickle import register_pickle_by_value

import sys

# Functions that run in Python workers travel with the plan, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
