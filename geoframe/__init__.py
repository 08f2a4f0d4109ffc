"""geoframe: feature layers, planar geometry and bulk data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so that
# executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
