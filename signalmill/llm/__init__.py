"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so a cluster needs the third-party libraries only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
