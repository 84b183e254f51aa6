"""harrow: listing curation on Spark.

Reads landed job-board JSON and HTML pages, normalises them to one listing
shape, gates them with relevance rules and a four-tier filter, classifies and
fingerprints them, removes duplicates with an ordered two-key rule against a
store, and maintains that store.  Every operator is a DataFrame -> DataFrame
or Column -> Column function built from Spark's own expressions.
"""

from harrow.config import CurationConfig

__all__ = ["CurationConfig"]
