"""lumenfold: spectral event analytics and corpus operators expressed as Spark plans."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Functions handed to Spark travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
