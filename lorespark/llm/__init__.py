"""Operators that prepare text corpora for training language models.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` uses it.
"""
