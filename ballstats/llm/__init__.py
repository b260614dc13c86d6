"""Operators for preparing training text. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get these functions together with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
