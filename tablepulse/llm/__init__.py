"""Operators for preparing training text. Nothing else in the library imports this subpackage.

Functions that run in Python workers are shipped by value, so executors need not have this package. They need numpy, pyarrow
and xxhash, and for token counts also ahocorasick, sentencepiece and the vocabulary file.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
