"""A PySpark-native engine that denoises mixed amplicon samples, with operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# executors needn't have the package installed: functions sent to them carry their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])
