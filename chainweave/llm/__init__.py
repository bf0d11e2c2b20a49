"""Operators for training-data pipelines over documents, pages and conversations.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and
``__spark_entry__.py`` are its only users.
"""
