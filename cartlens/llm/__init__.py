"""Training-data operators over document, page and embedding tables.

Each module is one operator with a general interface; ``queries`` wraps them
as the registered ``opN_`` queries. Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so executors need no
# copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
