"""Document-knowledge analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no installed copy: the small Arrow helpers travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
