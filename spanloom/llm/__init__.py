"""Operations of a training-data pipeline: ten operators over a table of documents.

Nothing outside this folder imports it. Each operator is one module with a general interface;
``queries`` holds the thin registered queries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
