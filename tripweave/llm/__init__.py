"""Corpus preparation for language-model training data.

Ten operators over tables of documents and pages, each in a module of its
own, and ``queries`` which applies them to the standard tables. Nothing else
in the library imports this subpackage.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need not have the package installed: its functions travel by value.
register_pickle_by_value(sys.modules[__name__])
