"""Operators for preparing language-model training corpora.

Each module holds one operator with a general interface; ``queries`` binds
them to the fixture tables.  Nothing outside this subpackage imports it.
"""
