"""Operators of a training-data pipeline over corpora of documents, pages and media.

Nothing outside this subpackage imports it.
"""
