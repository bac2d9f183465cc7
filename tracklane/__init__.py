"""Movement-stream analytics on Spark: keyed-stream operators and what is built from them."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
