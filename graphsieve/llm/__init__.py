"""Operators of a training-data pipeline: scoring, tokenising, packing, near-duplicate and vector search.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
