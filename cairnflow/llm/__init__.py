"""Operators of a training-data pipeline: sanitising, deduplication, tokenising, packing and scoring.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
