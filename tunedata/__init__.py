"""Spark-native preparation and monitoring of fine-tuning data.

Everything here takes and returns DataFrames or Columns; nothing collects a dataset.
"""

import sys

from pyspark import cloudpickle

from tunedata.operators.detect import Detection, detect
from tunedata.operators.normalize import normalize
from tunedata.sources.files import load_dataset

__all__ = ["Detection", "detect", "load_dataset", "normalize"]

# The few functions that run in Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
