"""Point-in-time (bitemporal) time-series analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python task helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
