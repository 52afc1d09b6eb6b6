"""Operators that prepare text corpora for model training.

Nothing else in the package imports this folder; the entry module adds its queries
when it is there.
"""
