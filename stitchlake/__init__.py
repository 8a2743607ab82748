"""Spatial alignment analytics as DataFrame plans, with a subpackage for training-data pipelines."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code: workers need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
