"""Training-data operators (mixing, search, scans, classifiers, joins, language ID).

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its
queries when it can be imported.
"""
