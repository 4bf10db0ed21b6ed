"""Operators for large-scale text corpora: counting, extraction, scanning,
deduplication, decontamination, mixing and binary output.

Each module is one operator; ``queries`` registers one query per operator.
Functions that run in Python workers are pickled by value, so a job carries
them along and executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
