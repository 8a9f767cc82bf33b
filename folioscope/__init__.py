"""Document-corpus analytics on Spark.

Office packages, PDFs, markup pages and spreadsheets become tables keyed by
``doc_id``; every operator takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

from folioscope.session import build_session

# The few Python functions travel to executors by value: no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
