"""Training-data operators: classifiers, near and exact duplicates, mixing,
packing, search and chat formatting, each a Spark job over whole tables.

Nothing outside this package imports it; ``corpus_pipeline.py`` at the
repository top chains five of the operators.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that a cluster without
# this package installed can run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
