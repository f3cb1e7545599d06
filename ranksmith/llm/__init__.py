"""Training-data operators: quality, mixing, deduplication, packing, search, chat, HTML, media, toxicity.

Nothing else in the library imports this subpackage.  Its modules travel to the
executors by value, so a cluster needs only the third-party libraries, not this
source tree, on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
