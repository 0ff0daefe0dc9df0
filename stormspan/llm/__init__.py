"""Training-data operators: filtering, deduplication, classification, packing and archives.

Nothing outside this subpackage imports it.
"""

import stormspan
from pyspark import cloudpickle

# Worker processes receive the code of this package with each job, so a cluster needs no separate installation.
cloudpickle.register_pickle_by_value(stormspan)
