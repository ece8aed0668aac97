"""Operations of a training-data pipeline over text, pages, conversations and vectors."""

import sys

from pyspark import cloudpickle

# Tasks get the code of this package with their closures, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
