"""Operators that prepare text corpora and embeddings for training.

Nothing outside this subpackage imports it. Every operator is a function from DataFrames
to DataFrames with its own parameters; the ``opN_*`` query beside it applies it to a
whole table and keeps the digest columns.
"""
