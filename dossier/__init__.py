"""Corpus, matching and retrieval operators for Spark tables and streams.

Every public operator takes and returns DataFrames (``operators``, ``sources``,
``streaming``) or Columns (``functions``); ``plans`` holds ready-made queries
over the given tables.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
