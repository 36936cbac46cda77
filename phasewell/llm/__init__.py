"""Operators for training-data corpora. Nothing else in the library imports this subpackage.

Each operator module has a general interface over any DataFrame with a text column and a thin
``opN_<name>(spark, sf_dir)`` query over the ``documents`` table; ``catalog`` lists the queries
and their SQL.
"""
