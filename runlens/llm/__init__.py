"""Operators for building training corpora: filters, scores, joins, hashes and tokens.

Every operator takes and returns DataFrames. Nothing else in the library
imports this subpackage. ``queries`` holds the registered queries.
"""
