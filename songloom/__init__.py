"""Track-catalogue analytics and similarity search as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the task, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
