"""Lattica: entity-and-relation analytics on PySpark.

Tables of entities keyed by a stable id, columns on them, index relations
between them and named row subsets, with gather/scatter joins, reductions,
scans, partitions, histories and comparisons expressed on DataFrames.
"""

__version__ = "0.1.0"

import os

# Numeric work here runs in many processes at once or on small arrays: one thread each for the linear-algebra library,
# unless the user says otherwise.  (Takes effect where numpy is not loaded yet.)
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
