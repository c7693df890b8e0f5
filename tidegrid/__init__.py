"""tidegrid: event detection in long sensor series as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from tidegrid.config import FlatSignalConfig, GridConfig, PeakConfig

# group functions travel to the executors by value, so the package need not be there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FlatSignalConfig", "GridConfig", "PeakConfig"]
