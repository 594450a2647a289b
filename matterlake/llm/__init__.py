"""Operators of a training-data pipeline over document and page tables.

Nothing else in the library imports this package.  ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five.
"""

from pyspark import cloudpickle

import matterlake

# Helper functions travel with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(matterlake)
