"""pairlens: sentence-pair (premise / hypothesis) evaluation of text
generators as lazy Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package run inside Python workers (the generator hook,
# per-batch runners). Pickle them by value so executors do not need the
# package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on --py-files
    pass
