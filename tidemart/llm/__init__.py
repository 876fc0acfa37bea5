"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; `queries` registers one
`opN_<name>` query per operator.
"""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
