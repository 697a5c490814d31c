"""Operators for training-data corpora: duplicates, languages, secrets, licences, benchmarks, tokens.

Nothing outside this subpackage imports it.
"""
