"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may be deleted whole.
Every operator is a function or small class over DataFrames.  Operators name the
columns they use, select only those, and return only the columns they document,
so extra input columns never clash.
"""
