"""Operators for large text corpora: language, benchmark leaks, toxicity, URL
lists, exact and near copies, sharding, mixing and quality.

Nothing else in the library imports this subpackage.  ``queries`` registers
one query per operator and the pipeline.
"""
