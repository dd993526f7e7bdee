"""lumenqa: retrieval-QA analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run there travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
