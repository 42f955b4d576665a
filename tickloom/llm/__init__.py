"""Training-data operators (text scoring, dedup, decontamination, archives, sharding).

Nothing outside this subpackage imports it.  Functions shipped to executors are pickled by
value, so workers need numpy and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
