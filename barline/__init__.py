"""barline: point-in-time analytics for keyed, time-ordered tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors do not need the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
