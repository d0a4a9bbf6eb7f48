"""Field-count analytics on Spark: messy survey sheets in, rates, trends and count models out."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# tasks carry the package's own functions, so workers need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
