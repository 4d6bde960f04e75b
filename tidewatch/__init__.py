"""Tidewatch: burst and event analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what Python workers run travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
