"""Case files as Spark jobs: ingest, normalise, parse, enrich, keep state, serve."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the task that uses them, so a cluster
# needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
