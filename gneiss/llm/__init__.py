"""Operators for preparing large text corpora: filtering, deduplication, scoring, mixing and archiving."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
