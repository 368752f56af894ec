"""Operators of a large-scale training-data pipeline, their queries and their SQL.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which counts as
part of it) imports it. Functions that run inside tasks are pickled by value,
so executors do not need this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
