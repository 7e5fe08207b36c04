"""ferryline: bounded record transfer and reshaping on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from ferryline.errors import EmptyRangeError, SpecError

# Functions and the file sink reach the executors inside the task, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EmptyRangeError", "SpecError"]
