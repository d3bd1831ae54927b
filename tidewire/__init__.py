"""Tidewire: article ingestion, deduplication and captioning as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with their job, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
