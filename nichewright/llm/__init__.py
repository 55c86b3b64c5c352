"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface; ``queries`` binds the
operators to the registered ``opN_`` queries with their production parameters.
"""
