"""Operators of a training-data pipeline: near-duplicates, language, quality, mixing, search, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
