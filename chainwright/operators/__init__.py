"""See the package README for the contents of this folder."""

import sys

from pyspark import cloudpickle

# task code is sent by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
