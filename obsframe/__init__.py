"""Analytics over service telemetry, agent state and benchmark records on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors as code, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
