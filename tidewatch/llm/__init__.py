"""Operators for building training data at scale; nothing else in this library imports them.

Every operator takes and returns DataFrames. Each module names its method, the defined result for nulls, empty and very
long texts, ties, repeated rows and empty tables, and ends with the thin query ``opN_<name>`` registered in ``registry``.
"""
