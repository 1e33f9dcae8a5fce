"""Operators for preparing training data: packing, chat formatting, quality,
language, secrets, tokens, archives, near-duplicates, toxicity, embeddings.

Nothing outside this folder imports it, except `corpus_pipeline.py` and the
guarded part of `__spark_entry__.py`.
"""
