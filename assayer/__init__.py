"""assayer: Spark-native evaluation of answers against evidence."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow steps travel to Python workers inside the task, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
