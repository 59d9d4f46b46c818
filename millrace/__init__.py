"""millrace: DataFrame operators for profiling, quality, KPIs, anomalies, series, segments,
statistics, text, pages, governance and streams, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions passed to the executors carry the code they need, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
