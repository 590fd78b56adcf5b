"""Change-impact analytics over code and test graphs, as Spark DataFrames.

Functions of this package that run on executors are sent by value, so workers need
pyspark, pyarrow and numpy but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
