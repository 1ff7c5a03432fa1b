"""cellgrid: gridded time-series analytics on Spark DataFrames.

Cells live in one long table ``(variable, day, time, lat, lon, value)``; whole tables of
requests, plans, questions and log rows are answered at once.  Every operator takes and
returns DataFrames built from Spark's own functions; the request limiter is the one
operator that folds ordered rows in pandas.
"""

import sys

from pyspark import cloudpickle

from cellgrid.session import get_spark

# Functions of this package travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark"]
