"""dialwise: contact-campaign analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions travel with their task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
