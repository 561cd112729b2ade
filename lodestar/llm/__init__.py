"""Operators for training-data pipelines: tokenising, filtering, deduplicating and packing a corpus of documents.

Nothing outside this package imports it. Each module holds one operator with a general interface; ``queries.py`` binds
them to the tables. Every operator treats a null text as an empty one, passes null ids through, never looks at columns
other than those it names, and returns an empty frame of the same schema for an empty table.
"""
