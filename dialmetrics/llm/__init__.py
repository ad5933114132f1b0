"""Operators of a training-data pipeline (documents, embeddings, labels).

Nothing else in the library imports this subpackage. The functions that run
inside Python tasks are shipped by value, so executors need no copy of the
library on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
