"""Operators for large-scale training-data preparation.

DataFrame operators: tokenisation, near-duplicate search, source mixing, scans, quality rules, language-model
scoring, manifests, collocations and fingerprints.  Nothing outside this subpackage imports it.
"""
