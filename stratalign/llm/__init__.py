"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only where it can be imported.  Worker functions are pickled by
value, so that executors need numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
