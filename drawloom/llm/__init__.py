"""Operators for preparing large-scale text training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, selects the columns it needs first (so extra or clashing input
columns never matter) and documents what it does with nulls, empties and ties.
"""
