"""Tidewater: market-panel analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
