"""Spark-native analytics over the activity of AI coding agents."""

import sys

from pyspark import cloudpickle

# Python helpers that run in tasks travel with the job, so that executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
