"""Label short texts under a grid of prompt conditions and score the labels, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on the workers travel with the job, so that the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
