"""Operators for preparing training data: scans, classifiers, tokenization, deduplication.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
