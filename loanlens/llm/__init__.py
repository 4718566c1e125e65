"""Operators of a training-data pipeline: decontamination, toxicity, quality rules and scores,
mixing, substring / line / near-duplicate removal, URL and licence filters.

Nothing outside this package imports it. Task code is shipped to Python workers by value, so
executors need numpy and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
