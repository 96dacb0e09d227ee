"""braidview: multi-view latent-factor analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import cloudpickle

# functions sent to the executors travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
