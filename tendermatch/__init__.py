"""tendermatch: a Spark-native engine for two-sided matching data.

Notices and the companies that bid on them are read as DataFrames, profiled,
preprocessed with fitted statistics, joined into pairs, packed into batches,
scored with given weights and evaluated with retrieval metrics -- all as Spark
jobs (DataFrame / SQL / Structured Streaming, Arrow-batched pandas where NumPy
maths is needed).
"""

import sys

from pyspark import cloudpickle

from tendermatch.session import build_session, checkpoint_dir  # noqa: F401

# Python code that runs inside tasks (pandas UDF bodies, mapInPandas /
# applyInPandas functions) is shipped by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpoint_dir"]
