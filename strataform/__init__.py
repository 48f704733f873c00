"""A PySpark-native engine for hybrid document retrieval and corpus preparation."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors carry their own code, so that no executor needs
# this package installed.
register_pickle_by_value(sys.modules[__name__])
