"""flowlab: Spark-native operators for labeled network-traffic tables.

Labeling and ingestion, exact-quota splits, train-only scaling, exact kNN
joins, SMOTE balancing, model wrappers, evaluation and run-record tables,
all written as DataFrame / SQL / Spark ML plans.
"""

import sys

__version__ = "0.1.0"

# Python code that runs inside tasks (pandas UDF kernels and their helpers) is
# shipped by value, so executors need no installed copy of this package.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
