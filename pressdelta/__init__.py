"""Media revision analytics on PySpark: revisions, topics, differences, findings."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with the plan, so a
# cluster needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
