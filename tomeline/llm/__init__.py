"""Operators of a training-data pipeline: text, vectors, pages and conversations.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` applies each to its whole table.
"""
