"""Training-data operators: media columns, dedup, classifiers, scoring, packing.

Nothing outside this subpackage imports it.
"""
