"""Operators for preparing language-model training corpora.

Each module holds one operator with its own general interface.  ``queries``
derives the registered result tables from them.  Nothing outside this
subpackage imports it.
"""
