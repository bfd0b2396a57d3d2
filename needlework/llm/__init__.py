"""Training-data operators: cleaning, near-duplicates, classifiers, token files, mixing.

Nothing outside this package imports it.  ``registry`` holds the queries and their SQL.
"""
