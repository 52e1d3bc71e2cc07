"""flowlake: network-flow analytics as Spark jobs.

Sub-packages
    sources    readers, sinks and durable tables
    functions  column expressions (no jobs, no shuffles)
    operators  DataFrame-to-DataFrame operators
    streaming  bounded drains and continuous receipt
    plans      the registered queries and their SQL twins
"""

import sys

from pyspark import cloudpickle

# task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
