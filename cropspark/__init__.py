"""Crop-risk analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run on executors travel with their task, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
