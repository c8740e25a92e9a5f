"""Operators for training-data pipelines; ``catalog`` registers their queries."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with the tasks, which need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
