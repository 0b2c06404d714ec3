"""Operators for preparing training data: cleaning, deduplication, search, tokens, chat text and packing.

Nothing outside this subpackage imports it, apart from the guarded import in ``__spark_entry__``.
"""
