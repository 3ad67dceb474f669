"""Operators of a training-data pipeline: search, scans, dedup, tokens, packing.

Nothing outside this package imports it.  ``queries`` registers one query per
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
