"""riskloom: order-risk analytics as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside Python workers (mapInArrow, applyInPandas,
# mapInPandas) are shipped by value, so executors need no installed copy
# of this package and any working directory works.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["config", "session"]
