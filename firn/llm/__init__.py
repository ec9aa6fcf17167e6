"""Training-data operators. Nothing else in the library imports this package.

Task functions travel with the job itself, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
