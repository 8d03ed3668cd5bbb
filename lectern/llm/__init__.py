"""Operators for preparing large text corpora as training data.

Each module holds one operator with its own general interface; ``queries``
derives from them the digest queries that the driver runs.  Nothing outside
this subpackage imports it.
"""
