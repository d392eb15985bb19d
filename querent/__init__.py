"""querent: question-corpus and interview analytics as Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

__version__ = "0.1.0"

# Functions travel to the workers by value, so the package need not be
# installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
