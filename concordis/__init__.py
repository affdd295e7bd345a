"""Evaluation of transcription ensembles on Spark."""

import sys

from pyspark import cloudpickle

# Column functions travel to the executors with their code, so no node needs this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
