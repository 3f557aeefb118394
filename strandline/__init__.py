"""strandline: document retrieval and corpus analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with the plan, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
