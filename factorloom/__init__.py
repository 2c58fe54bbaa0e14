"""Latent-factor analytics of sparse ratings as Spark plans."""

import sys

from pyspark import cloudpickle

# Workers get the operators' functions with the task, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
