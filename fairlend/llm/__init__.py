"""Operators for preparing large text and vector collections for training.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers them, ``corpus_pipeline.py`` at the repository
top chains five of them.
"""
