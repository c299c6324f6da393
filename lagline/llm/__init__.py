"""Operators for training-data pipelines.

What runs inside Python workers is sent along with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
