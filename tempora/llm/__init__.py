"""Training-data operators: tokenising, extraction, near-duplicates, classifiers, packing.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
registered queries, one module per operator holds the work.
"""
