"""Corpus metrics, vector probes and evaluation reports as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Python tasks carry the package with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
