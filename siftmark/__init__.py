"""siftmark: a PySpark-native engine for labelled short-text corpora.

Every operator is a ``DataFrame -> DataFrame`` function or a ``Column`` factory
that Catalyst plans; nothing here schedules work by hand.
"""

__version__ = "0.1.0"
