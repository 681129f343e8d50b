"""Operators for building language-model training data.

Python workers get this code with the task, so nothing need be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
