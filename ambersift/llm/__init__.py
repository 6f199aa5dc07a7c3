"""Operators for training-data pipelines; nothing else in the library imports them.

The functions of this package that run inside tasks travel with the job, so
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
