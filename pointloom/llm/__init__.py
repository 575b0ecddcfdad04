"""Operators for preparing language-model training text.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
