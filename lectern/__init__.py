"""Spark-native preparation of books and web pages for text-to-speech.

The unit of work is a DataFrame with one row per chapter.  ``functions`` holds
``Column -> Column`` building blocks, ``operators`` the ``DataFrame ->
DataFrame`` steps (titles, rules, numbering, audio manifest), ``sources`` the
readers and writers, ``plans`` the end-to-end tables and ``streaming`` the
incremental versions of the same tables.
"""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves; they need the package for broadcast models only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
