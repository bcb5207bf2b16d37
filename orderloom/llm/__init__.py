"""Operators for preparing training data at corpus scale.

Each module holds one operator; ``queries`` registers them.  Nothing outside this
subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Python workers then need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
